"""Media columns: types by signature, checked by structure, and embedded media carved out.

One Aho-Corasick automaton finds the magic bytes of all known formats in a value in one pass. Each hit is a
candidate; the format's validator reads the structure from there and returns the length that it proves, or
nothing. A value's type is that of the validated medium at its start, whatever was declared; validated
media further in are carved (offset, length, type). A hit inside a medium that was already taken is part of it.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

RATE = 8000
UNIT = 64


def wav8(samples: bytes) -> bytes:
    """A RIFF file of 8-bit mono samples. Chunks have even lengths, so an odd number gets a pad byte outside the data."""
    if len(samples) > 0xFFFFFFFF - 64:
        raise ValueError("more samples than a RIFF file can hold")
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + bytes(pad)


def _riff(data, at: int, marks=None):
    """(length, samples' start, samples' length) of a WAVE file at a place."""
    if len(data) < at + 12 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    p, known, samples = at + 12, False, None
    while p + 8 <= end:
        size = struct.unpack_from("<I", data, p + 4)[0]
        if p + 8 + size > end:
            return None
        if data[p : p + 4] == b"fmt ":
            known = size >= 16
        elif data[p : p + 4] == b"data":
            samples = p + 8, size
        p += 8 + size + (size & 1)
    return (end - at, *samples) if known and samples and p == end else None


def _png(data, at: int, marks=None):
    p = at + 8
    while p + 12 <= len(data):
        size, kind = struct.unpack_from(">I", data, p)[0], bytes(data[p + 4 : p + 8])
        if p + 12 + size > len(data) or zlib.crc32(data[p + 4 : p + 8 + size]) != struct.unpack_from(">I", data, p + 8 + size)[0]:
            return None
        if p == at + 8 and (kind != b"IHDR" or size != 13):
            return None
        p += 12 + size
        if kind == b"IEND":
            return (p - at,)
    return None


def _gif(data, at: int, marks=None):
    def blocks(p):
        while p < len(data) and data[p]:
            p += 1 + data[p]
        return p + 1

    if len(data) < at + 13:
        return None
    p = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0)
    while p < len(data):
        if data[p] == 0x3B:
            return (p + 1 - at,)
        if data[p] == 0x21:
            p = blocks(p + 2)
        elif data[p] == 0x2C and p + 10 < len(data):
            p = blocks(p + 10 + (3 << (data[p + 9] & 7) + 1 if data[p + 9] & 0x80 else 0) + 1)
        else:
            return None
    return None


def _jpeg(data, at: int, marks=None):
    p = at + 2
    while p + 4 <= len(data):
        if data[p] != 0xFF:
            return None
        kind = data[p + 1]
        if kind == 0xD9:
            return (p + 2 - at,)
        if kind == 0xFF or 0xD0 <= kind <= 0xD7:
            p += 1 if kind == 0xFF else 2
            continue
        size = struct.unpack_from(">H", data, p + 2)[0]
        if size < 2:
            return None
        p += 2 + size
        if kind == 0xDA:  # entropy-coded data up to the next marker
            while (p := data.find(b"\xff", p)) >= 0 and p + 1 < len(data) and (data[p + 1] == 0 or 0xD0 <= data[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
    return (p + 2 - at,) if data[p : p + 2] == b"\xff\xd9" else None


class _Marks:
    """Places of end marks in a value, each kind searched for once, however many beginnings there are."""

    def __init__(self, data: bytes):
        self.data, self.places = data, {}

    def of(self, mark: bytes) -> list[int]:
        if mark not in self.places:
            out, at = [], self.data.find(mark)
            while at >= 0:
                out.append(at)
                at = self.data.find(mark, at + 1)
            self.places[mark] = out
        return self.places[mark]

    def first(self, mark: bytes, at: int) -> int:
        """The first place from ``at`` on, or -1."""
        own = self.of(mark)
        k = bisect.bisect_left(own, at)
        return own[k] if k < len(own) else -1


def _pdf(data, at: int, marks: _Marks):
    end, near = marks.first(b"%%EOF", at), marks.first(b"startxref", at)
    return (end + 5 - at,) if 0 <= near < end else None


def _zip(data, at: int, marks: _Marks):
    """By its end record, which tells where the directory begins, counted from the archive's start."""
    ends = marks.places.get("zip")
    if ends is None:  # by start of the archive: its end records
        ends = marks.places["zip"] = {}
        for end in marks.of(b"PK\x05\x06"):
            if end + 22 <= len(data):
                size, start, comment = struct.unpack_from("<IIH", data, end + 12)
                first = end - size - start
                if first >= 0 and end + 22 + comment <= len(data) and (size == 0 or data[first + start : first + start + 4] == b"PK\x01\x02"):
                    ends.setdefault(first, end + 22 + comment)
    return (ends[at] - at,) if at in ends else None


def _gzip(data, at: int, marks=None):
    machine, p = zlib.decompressobj(31), at
    try:
        while p < len(data) and not machine.eof:
            machine.decompress(data[p : p + 65536])
            p += 65536
    except zlib.error:
        return None
    return (min(p, len(data)) - len(machine.unused_data) - at,) if machine.eof else None


def _bmp(data, at: int, marks=None):
    if len(data) < at + 26:
        return None
    size, _, pixels, head = struct.unpack_from("<IIII", data, at + 2)
    return (size,) if head in (12, 40, 52, 56, 108, 124) and 14 + head <= pixels <= size and at + size <= len(data) else None


#: Magic bytes (public format definitions), media type and validator.
FORMATS = (
    (b"RIFF", "audio/wav", _riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"BM", "image/bmp", _bmp),
)
UNKNOWN = "application/octet-stream"


class Sniffer:
    """The automaton over all magic bytes (as Latin-1 text, one character a byte)."""

    def __init__(self, formats=FORMATS):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(formats):
            self.machine.add_word(magic.decode("latin-1"), k)
        self.machine.make_automaton()
        self.formats = formats

    def media(self, data: bytes) -> list[tuple]:
        """(offset, length, type, ...) of validated media that don't lie in another, by offset."""
        hits = sorted((end - len(self.formats[k][0]) + 1, k) for end, k in self.machine.iter(data.decode("latin-1")))
        out, free, marks = [], 0, _Marks(data)
        for at, k in hits:
            if at >= free and (found := self.formats[k][2](data, at, marks)) is not None:
                out.append((at, found[0], self.formats[k][1], *found[1:]))
                free = at + found[0]
        return out

    def sniff(self, data: bytes) -> tuple[str, list[tuple]]:
        """The type of a value, and the media carved from it: all but one that is the whole value."""
        found = self.media(data)
        kind = found[0][2] if found and found[0][0] == 0 else UNKNOWN
        return kind, [m for m in found if m[:2] != (0, len(data))]


_SNIFFER: list[Sniffer] = []


def _sniffer() -> Sniffer:
    if not _SNIFFER:
        _SNIFFER.append(Sniffer())
    return _SNIFFER[0]


def correct_types(media: DataFrame) -> DataFrame:
    """(id, declared, media) to (id, declared, type, corrected, carved): types by structure, embedded media by place.

    A null value has a null type and no carved media; one without a known medium at its start has type
    application/octet-stream. corrected tells whether declared differs (null counts as differing).
    """

    def work(batches):
        own = _sniffer()
        for b in batches:
            kinds, carved = [], []
            for x in b.column(2):
                data = x.as_py()
                kind, inside = (None, []) if data is None else own.sniff(data)
                kinds.append(kind)
                carved.append([{"at": m[0], "length": m[1], "type": m[2]} for m in inside])
            off = [k != d for k, d in zip(kinds, b.column(1).to_pylist())]
            place = pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.string()), pa.array(off), pa.array(carved, place)], ["id", "declared", "type", "corrected", "carved"])

    return media.select(F.col("id").cast("long"), "declared", "media").mapInArrow(work, "id long, declared string, type string, corrected boolean, carved array<struct<at: long, length: long, type: string>>")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each whole text as a WAVE file of its UTF-8 bytes.

    Bytes 0 fill the samples up to a positive multiple of 64; null text is empty. The declared type is
    what the source claims (text/plain), for the sniffer to correct.
    """

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                wavs = [wav8(x + bytes(-len(x) % UNIT if x else UNIT)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(["text/plain"] * len(raw)), pa.array(wavs, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_bytes long, declared string, media binary")


def features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, from their bytes: the sniffer must find a WAVE file there.

    The feature gives type, whether the declared type was corrected, sampling rate, samples, how many
    differ from 0, their mean level, and what media the samples hold.
    """

    def work(batches):
        own = _sniffer()
        for b in batches:
            out: list[tuple] = []
            for declared, data in zip(b.column(2).to_pylist(), b.column(3)):
                data = data.as_py()
                found = own.media(data)
                if not found or found[0][:3] != (0, len(data), "audio/wav"):
                    raise ValueError("a stored value isn't the WAVE file that was written")
                at, size = found[0][3:5]
                payload = data[at : at + size]
                inside = own.media(payload)
                rate = struct.unpack_from("<I", data, 24)[0]
                level = sum(memoryview(payload)) / size
                feature = f"type={found[0][2]};corrected={declared != found[0][2]};rate={rate};samples={size};silent={payload.count(0)};level={level:.6f};carved=" + ",".join(f"{m[2]}@{m[0]}+{m[1]}" for m in inside)
                out.append((size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every text stored as a medium in the shared folder, read back, sniffed and digested.

    Repeated rows come out as often as they came in; an empty table gives an empty result.
    """
    work = Workspace(spark, "media")
    return features(work.table(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
