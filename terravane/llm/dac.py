"""Token ids in a binary format of directly addressable codes.

A shard holds the ids of consecutive documents. An id is cut into chunks of 8 bits, least significant
first; level 0 has the first chunk of every id, level k + 1 the next chunk of those ids that go on. A
bitmap beside each level but the last tells which ids go on, and a rank directory holds the number of set
bits before every 512th bit, so that one id is reached by a look at each level: no block is decoded.

Shard (little-endian): magic ``DAC1``, u32 levels, u64 ids, u64 documents; for each level u64 entries and,
but for the last, u64 bitmap bytes; doc_id i64 of every document; a byte of every document, 1 where it has no
doc_id; first id u64 of every document and the number of ids; then each level's chunks, its bitmap and its
directory (u64 each). Shards are the rows of a
table, one binary value each, which Spark commits as a whole: a lost executor's shards are written again.
"""

from __future__ import annotations

import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import Workspace, held, no_cycles
from .pieces import END, HEAD, SIMPLE, Cutter, blocks, joined

MAGIC = b"DAC1"
EVERY = 512  # bits a rank entry
END_ID = 2


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, none: np.ndarray | None = None) -> bytes:
    """A shard of documents, counts[i] ids each, all ids in order; none: which documents have no doc_id."""
    doc_ids, counts, ids = np.asarray(doc_ids, "<i8"), np.asarray(counts, np.int64), np.asarray(ids, np.uint32)
    parts, heads, rest = [], [], ids
    while True:
        chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        on = rest != 0
        # an entry of a level is there because its id goes on, so its last chunk may stop anywhere
        if not on.any():
            heads.append((len(chunk), 0))
            parts.append(chunk.tobytes())
            break
        bits = np.packbits(on, bitorder="little")
        before = np.concatenate([[0], np.cumsum(on, dtype=np.int64)])[:: EVERY].astype("<u8")
        heads.append((len(chunk), len(bits)))
        parts += [chunk.tobytes(), bits.tobytes(), before.tobytes()]
        rest = rest[on]
    first = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    head = MAGIC + struct.pack("<IQQ", len(heads), len(ids), len(doc_ids)) + b"".join(struct.pack("<QQ", *h) for h in heads)
    flags = np.zeros(len(doc_ids), np.uint8) if none is None else np.asarray(none, np.uint8)
    return b"".join([head, doc_ids.tobytes(), flags.tobytes(), first.tobytes(), *parts])


class Shard:
    """Random access to a packed shard; arrays are views of its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 shard")
        levels, self.n_ids, self.n_docs = struct.unpack_from("<IQQ", data, 4)
        at = 24
        heads = [struct.unpack_from("<QQ", data, at + 16 * k) for k in range(levels)]
        at += 16 * levels

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.none = take("<i8", self.n_docs), take("u1", self.n_docs).astype(bool)
        self.first = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for entries, size in heads:
            chunk = take("u1", entries)
            self.levels.append((chunk, take("u1", size), take("<u8", entries // EVERY + 1)) if size else (chunk, None, None))
        if at != len(data):
            raise ValueError("shard of wrong length")

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block = i // EVERY
        part = np.unpackbits(bits[block * EVERY // 8 : i // 8 + 1], bitorder="little")[: i - block * EVERY]
        return int(before[block]) + int(part.sum())

    def __getitem__(self, i: int) -> int:
        """One id, by a look at each of its levels."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out, shift = 0, 0
        for chunk, bits, before in self.levels:
            out |= int(chunk[i]) << shift
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                return out
            i, shift = self._rank(bits, before, i), shift + 8
        raise ValueError("shard ends within an id")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range, by the same looks for all of it at once."""
        out, at, shift = np.zeros(stop - start, np.uint32), np.arange(stop - start), 0
        for chunk, bits, before in self.levels:
            out[at] |= chunk[start:stop].astype(np.uint32) << np.uint32(shift)
            if bits is None or start == stop:
                break
            on = np.unpackbits(bits[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            start = self._rank(bits, before, start)
            at, shift = at[on], shift + 8
            stop = start + len(at)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


class LibraryEncoder:
    """The tokenizers library, asked once for each piece of text that it splits off anyway.

    Pieces (``pieces.Cutter``) and their ids are remembered. When the table is full, its entries become the old
    ones, which stay while they are used. A word of letters is one pre-token, so the library's model is asked
    for it without the splitting before; marks after it are another. Other new pieces go to the whole library
    together in one call, where the bytes of each token tell where one piece's ids end. Texts that can't be cut
    go to the library whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        from .bpe import Vocabulary, byte_alphabet

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library, self.most = Tokenizer.from_file(path), most
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        vocabulary = Vocabulary(path)
        self.cutter = Cutter(vocabulary.added)
        self.size = np.zeros(max(vocabulary.decoded) + 1, np.int64)
        for i, b in vocabulary.decoded.items():
            self.size[i] = len(b)
        self.width = 2 if len(self.size) <= 1 << 16 else 4
        character = {b: c for c, b in byte_alphabet().items()}
        self.character, self.blank, self.feed = str.maketrans({chr(b): c for b, c in character.items()}), character[0x20], character[0x0A]
        self.line, self.end = self._ask(["\n"])[0], np.array([END_ID], f"<u{self.width}").tobytes()
        self.marks: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bases: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_model(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, with or without a blank before them."""
        spelt = "\n".join(words).encode().decode("latin-1").translate(self.character).split(self.feed)
        found = [[t.id for t in x] for x in map(self.model.tokenize, spelt)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) * self.width).tolist()
        raw = np.fromiter(chain.from_iterable(found), f"<u{self.width}").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _together(self, bodies: list[str], sep: str) -> list[bytes]:
        """Ids of pieces that don't end in white space, each with ``sep`` before it, asked as one text."""
        out: list[bytes] = []
        for at in range(0, len(bodies), 20_000):
            text = sep + sep.join(bodies[at : at + 20_000])
            raw = self._ask([text])[0]
            data = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(data == ord(sep))[1:], len(data))
            stop = ((np.searchsorted(np.cumsum(self.size[np.frombuffer(raw, f"<u{self.width}")]), ends) + 1) * self.width).tolist()
            out += [raw[a:b] for a, b in zip([0, *stop], stop)]
        return out

    def _learn(self, new: list[str]) -> None:
        known, old = self.known, self.old.get
        simple: list[tuple[str, str, str, str]] = []
        others: dict[str, list[tuple[str, str]]] = {" ": [], "\n": [], "": []}
        for p in new:
            if (b := old(p)) is not None:
                known[p] = b
            elif p == END:
                known[p] = self.end
            else:
                lead, body = ("", p[1:]) if p[0] == HEAD else ("\n", p[1:]) if p[0] == "\n" else (" ", p)
                if not body:
                    known[p] = self.line if lead else b""
                elif m := SIMPLE(body):
                    simple.append((p, lead, " " + m[1] if lead == " " else m[1], m[2]))
                else:
                    others["" if not lead or body[-1].isspace() else lead].append((p, body if not lead else lead + body))
        words = list({x[2] for x in simple}.difference(self.bases))
        if len(self.bases) + len(words) > self.most:
            self.bases = {}
            words = list({x[2] for x in simple})
        self.bases.update(zip(words, self._ask_model(words) if words else []))
        marks = list({x[3] for x in simple}.difference(self.marks))
        if len(self.marks) + len(marks) > self.most:
            self.marks = {"": b""}
            marks = list({x[3] for x in simple} - {""})
        self.marks.update(zip(marks, self._ask(marks)))
        bases, marks = self.bases, self.marks
        known.update([(p, (self.line if lead == "\n" else b"") + bases[word] + marks[tail]) for p, lead, word, tail in simple])
        for lead in (" ", "\n"):
            known.update(zip([p for p, _ in others[lead]], self._together([t[1:] for _, t in others[lead]], lead)))
        known.update(zip([p for p, _ in others[""]], self._ask([t for _, t in others[""]])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text with its end id, all ids in order)."""
        odd, different, indices, offsets = self.cutter.cut(texts)
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        pieces = different.to_pylist()
        known = self.known
        with no_cycles():
            if new := [p for p in pieces if p not in known]:
                self._learn(new)
        at, data = joined(list(map(known.__getitem__, pieces)), indices, offsets)
        counts, ids = np.diff(at) // self.width, np.frombuffer(data, f"<u{self.width}", int(at[-1]) // self.width)
        if odd.any():
            rows = np.flatnonzero(odd)
            whole = [np.frombuffer(x, ids.dtype) for x in self._ask(texts.take(pa.array(rows)).to_pylist())]
            starts = at[rows] // self.width  # an odd text has its end id only up to here
            counts[rows] += np.fromiter(map(len, whole), np.int64, len(whole))
            cuts = np.split(ids, starts)
            ids = np.concatenate([cuts[0], *(x for pair in zip(whole, cuts[1:]) for x in pair)])
        return counts, ids


def _library(path: str) -> LibraryEncoder:
    return held(("library", path), lambda: LibraryEncoder(path))


def write_shards(docs: DataFrame, work: Workspace, path: str | None = None, docs_a_shard: int = 2048, ids_a_shard: int = 4 << 20, name: str = "shards") -> DataFrame:
    """Encode ``docs`` (doc_id, text), end each with id 2 and write shards in ascending doc_id order.

    Returns the written table (part, number, n_ids, data); shards in order of (part, number) hold the documents
    in order. Rows are dealt out by ranges of (doc_id, hash of text, row), so rows of one doc_id or of none don't
    meet in one task; a task encodes its rows in order and cuts shards of at most ``docs_a_shard`` documents and,
    but for single documents, about ``ids_a_shard`` ids. Null text is empty; null doc_ids come first.
    """
    file = path
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = (F.asc_nulls_first("doc_id"), F.asc("h"), F.asc("row"))

    def build(batches):
        from pyspark import TaskContext

        own, part, number = _library(file or tokenizer_path()), TaskContext.get().partitionId(), 0
        doc_ids, none, counts, ids, n_docs, n_ids = [], [], [], [], 0, 0

        def shard():
            data = pack(np.concatenate(doc_ids), np.concatenate(counts), np.concatenate(ids), np.concatenate(none))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n_ids], pa.int64()), pa.array([data], pa.binary())], ["part", "number", "n_ids", "data"])

        for b in blocks(batches, 1, rows=8_000, size_of_text=24 << 20):
            known, flat = own.encode(b.column(1))
            ends = np.cumsum(known)
            missing = b.column(0).is_null().to_numpy(zero_copy_only=False)
            names = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(names):
                before = int(ends[at - 1]) if at else 0
                upto = int(np.searchsorted(ends, before + ids_a_shard - n_ids, side="right"))
                upto = min(max(upto, at if n_docs else at + 1), at + docs_a_shard - n_docs, len(names))
                if upto > at:
                    doc_ids.append(names[at:upto])
                    none.append(missing[at:upto])
                    counts.append(known[at:upto])
                    ids.append(flat[before : int(ends[upto - 1])])
                    n_docs, n_ids, at = n_docs + upto - at, n_ids + int(ends[upto - 1]) - before, upto
                if at < len(names):
                    yield shard()
                    number += 1
                    doc_ids, none, counts, ids, n_docs, n_ids = [], [], [], [], 0, 0
        if n_docs:
            yield shard()

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return work.table(dealt.select("doc_id", "text").mapInArrow(build, "part int, number int, n_ids long, data binary"), name)


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of written shards, each read by its address.

    start counts the ids of all documents before it: within a part by a running sum over its shards, before
    that by the sums of parts, a row a writing task.
    """
    from pyspark.sql import Window

    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a task of the writer
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts"))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select("part", "number", own.alias("own")).join(before, "part").select("part", "number", (F.col("own") + F.col("parts")).alias("base"))

    def work(batches):
        for b in batches:
            for p, k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = Shard(data.as_buffer())
                n = own.n_docs
                crc = [zlib.crc32(own.document(i).astype("<u4").tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int32()), pa.array([k] * n, pa.int32()), pa.array(own.doc_ids, pa.int64(), mask=own.none), pa.array(own.first[:-1]), pa.array(np.diff(own.first)), pa.array(crc, pa.int64())], ["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"])

    read = shards.select("part", "number", "data").mapInArrow(work, "part int, number int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "number"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: ids of all documents, written to shards and read back. An empty table gives an empty result."""
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "dac")))
