"""WARC records as a chunked table.

A record's bytes - header block, payload, end - are cut into rows (archive, record, page_id, chunk, chunks, at,
data, sha1), record being its number in the archive: no row holds more than ``CHUNK`` bytes, and sha1 is the digest of the payload up to and with
that row, so a reader knows at each row whether all is well so far. The rows of an archive, in order, are a
WARC/1.1 file. A record is written and read by a generator that holds a chunk and a running digest, not the
record. Of records with equal payloads that of the smallest id is a ``response``; the others are ``revisit``
records that name it and have no body.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

CHUNK = 1 << 18
SCHEMA = "archive int, record long, page_id long, chunk int, chunks int, at long, data binary, sha1 string"
#: Stands for a null page_id in a record's URN.
NO_ID = "none"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows and bytes of a batch between Spark and Python.
ROWS, BYTES = 500, 8 << 20


def base32(hexdigest: str) -> str:
    """Bare upper-case base32 of a SHA-1."""
    return base64.b32encode(bytes.fromhex(hexdigest)).decode()


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, refers_to), different rows: refers_to is the first record of equal payload if there is one before.

    Payloads are told apart by SHA-1 and length; those of fewer than ``least`` bytes are all responses, and so are
    those of a null page_id, which comes in no order. Only digests are shuffled, and the copies of one payload are
    reduced to their first before that.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).distinct()
    first = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"))
    again = (F.col("first") < F.col("page_id")) & (F.col("size") >= least)
    return rows.join(first, ["digest", "size"]).select("page_id", "digest", F.when(again, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, when: str):
    """The record's header block and its body: a revisit has none, but its payload's digest and length."""
    kind, name = "response" if refers_to is None else "revisit", NO_ID if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {when}",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(payload) if refers_to is None else 0}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), payload if refers_to is None else b""


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string())
    names = ("archive", "record", "page_id", "chunk", "chunks", "at", "data", "sha1")
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], list(names))


def write_chunks(pages: DataFrame, work: Workspace, least: int = 0, chunk: int = CHUNK, when: str = "2000-01-01T00:00:00Z", name: str = "chunks") -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the table of chunks.

    Null html is an empty payload; a null page_id gives a response of its own kind of name. Repeated rows, and
    rows of one page_id with different html, are all written: records are told apart by their number in the
    archive that a task writes. Other columns of ``pages`` are ignored. An empty table gives an empty one.
    """
    from pyspark import TaskContext

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    kinds = decide(own, least).select(F.col("page_id").alias("kind_id"), F.col("digest").alias("kind_digest"), "refers_to")
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = own.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.join(kinds, F.col("page_id").eqNullSafe(F.col("kind_id")) & (F.col("digest") == F.col("kind_digest")))

    def build(batches):
        archive, number, out, held = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page_id, digest, url, payload, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist()):
                body = memoryview(payload.as_buffer())
                head, body = record(page_id, url, body, digest, refers_to, when)
                running, n = hashlib.sha1(), max(1, -(-len(body) // chunk))
                for k in range(n):
                    part = body[k * chunk : (k + 1) * chunk]
                    running.update(part)
                    data = (head if k == 0 else b"") + bytes(part) + (b"\r\n\r\n" if k == n - 1 else b"")
                    out.append((archive, number, page_id, k, n, k * chunk, data, running.hexdigest()))
                    held += len(data)
                    if len(out) >= ROWS or held >= BYTES:
                        yield _batch(out)
                        out, held = [], 0
                number += 1
        if out:
            yield _batch(out)

    return work.table(rows.select("page_id", "digest", "url", "payload", "refers_to").mapInArrow(build, SCHEMA), name)


def _header(data: bytes) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    return dict(x.split(": ", 1) for x in lines[1:]), end + 4


def _id(urn: str) -> int | None:
    name = re.fullmatch(rf"<urn:page:(-?\d+|{NO_ID})>", urn)[1]
    return None if name == NO_ID else int(name)


def parse(chunks) -> list[tuple]:
    """Records of (record, chunk, chunks, data, sha1) in order, a chunk at a time, each digest checked."""
    out, head, running, left, size = [], {}, None, 0, 0
    for number, chunk, n, data, sha1 in chunks:
        if chunk == 0:
            head, at = _header(data)
            running, left, size = hashlib.sha1(), int(head["Content-Length"]), 0
            data = memoryview(data)[at:]
        body = data[: min(left, len(data))]
        running.update(body)
        left, size = left - len(body), size + len(body)
        if running.hexdigest() != sha1:
            raise ValueError(f"record {number} is damaged in chunk {chunk}")
        if chunk == n - 1:
            if left or bytes(data[len(body) :]) != b"\r\n\r\n":
                raise ValueError(f"record {number} doesn't end where it should")
            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and digest != base32(running.hexdigest()):
                raise ValueError(f"record {number} hasn't the payload that its header tells")
            length = size if kind == "response" else int(head["WARC-Payload-Length"])
            refers_to = _id(head["WARC-Refers-To"]) if kind == "revisit" else None
            out.append((_id(head["WARC-Record-ID"]), length, digest, kind, refers_to, head.get("WARC-Target-URI")))
    return out


def read_chunks(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) from the chunks' bytes.

    Records of one chunk are read where they lie. Those of several are brought together by archive and
    record and read in order, a chunk at a time.
    """

    def work(batches):
        def stream():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), (x.as_py() for x in b.column(3)), b.column(4).to_pylist())

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        for group in _groups(stream()):
            if group:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*group), kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    cols = ("record", "chunk", "chunks", "data", "sha1")
    single = chunks.where("chunks = 1").select(*cols).mapInArrow(work, schema)
    longer = chunks.where("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return single.unionByName(longer.select(*cols).mapInArrow(work, schema))


def _groups(rows, most: int = 2000):
    """Parsed records, so many at a time; the parser pulls rows itself, so a record is never held whole."""
    it, done = iter(rows), False
    while not done:
        count = 0

        def some():
            nonlocal count, done
            for row in it:
                yield row
                count += row[1] == row[2] - 1
                if count >= most:
                    return
            done = True

        yield parse(some())


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: pages written as WARC chunks in the shared folder and read back."""
    work = Workspace(spark, "warc")
    out = read_chunks(write_chunks(spark.read.parquet(f"{sf_dir}/pages.parquet"), work))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base32 of a SHA-1 in SQL: its 160 bits in 32 groups of 5.
OP4_SQL = r"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
f as (select page_id, body, hex, min(page_id) over (partition by body) as first from p),
b as (select *, list_aggregate(list_transform(range(40), lambda i: right(bin(('0x' || substr(hex, i + 1, 1))::int + 16), 4)), 'string_agg', '') as bits from f)
select page_id, strlen(body)::bigint as payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_aggregate(list_transform(range(5), lambda j: substr(bits, i * 5 + j + 1, 1)::int << (4 - j)::int), 'sum')::int + 1, 1)), 'string_agg', '') as payload_digest,
       case when first = page_id then 'response' else 'revisit' end as record_type,
       case when first < page_id then first end as refers_to
from b
"""
