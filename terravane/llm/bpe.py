"""Byte-level BPE by a bounded-lookahead streaming transducer, and decoding by an incremental state machine.

A sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours are (merging their
bytes from scratch gives the two again). So a window of bytes after a stable token is encoded from left to
right by longest matches that fit the token before, with a step back where none fits. Bytes that follow the
window can change its tokens only within the merge list's *sufficient lookahead*, which is computed from the
merges; tokens that end before it are stable and emitted, and only the rest is kept for the next window.
Memory is that of two lookaheads, whatever the length of the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import held, no_cycles, slices
from .pieces import END, HEAD, SIMPLE, Cutter, blocks, joined

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, the others for 256, 257, ... in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, byte = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec["normalizer"] or model.get("ignore_merges") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(byte[c] for c in s) for s, i in model["vocab"].items() if s not in self.added}
        of = {b: i for i, b in self.bytes.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {of[bytes([b])]: -1 for b in range(256)}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            u, v, w = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.pairs[u, v] = rank
            if w not in self.rank:  # a token is made by the first merge that gives it
                self.rank[w], self.halves[w] = rank, (u, v)
        self.of = {b: i for b, i in of.items() if i in self.rank}
        self.longest = max(map(len, self.of))
        self.decoded = self.bytes | {i: s.encode() for s, i in self.added.items()}
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """Bytes beyond a token after which it can't change any more.

        What follows can undo a merge only by taking its right half, or a piece on that half's right
        edge, as the left half of an earlier merge. So an effect travels left along a chain of merges of
        rising rank, one token a link; the longest chain times the longest token bounds its reach.
        """
        edge: dict[int, int] = {}  # by token: links of the longest chain that ends in a merge with that left half
        most = 0
        for (u, v), _ in sorted(self.pairs.items(), key=lambda x: x[1]):
            links, piece = 0, v
            while True:
                links = max(links, edge.get(piece, 0))
                if piece not in self.halves:
                    break
                piece = self.halves[piece][1]
            edge[u] = max(edge.get(u, 0), links + 1)
            most = max(most, links + 1)
        return (most + 1) * self.longest

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, merged from scratch, give a and b.

        The merges of either side are taken back, latest first; wherever the parts at the seam would
        have merged earlier than the parts that did, the answer is no.
        """
        pairs, rank, halves, bound = self.pairs, self.rank, self.halves, 1 << 60
        while True:
            r = pairs.get((a, b))
            if r is not None and r < bound:
                return False
            # of equal merges BPE does the left one first, so a right one is taken back before it,
            # and the seam goes before an equal merge on its right
            if rank[a] > rank[b]:
                bound, a = rank[a], halves[a][1]
            elif b in halves:
                bound, b = rank[b] + 1, halves[b][0]
            else:
                return True


class Transducer:
    """Encodes pre-tokens, a window at a time."""

    def __init__(self, vocabulary: Vocabulary, most_pairs: int = 300_000):
        self.v, self.most = vocabulary, most_pairs
        self.fits: dict[int, bool] = {}
        self.length = {t: len(b) for t, b in vocabulary.bytes.items()}
        lengths: dict[bytes, set[int]] = {}
        for b in vocabulary.of:
            if len(b) > 4:
                lengths.setdefault(b[:5], set()).add(len(b))
        self.short = (4, 3, 2, 1)
        self.reach = {b: (*sorted(n, reverse=True), *self.short) for b, n in lengths.items()}  # by the first five bytes: tokens' lengths

    def window(self, data: bytes, before: int = -1) -> list[int]:
        """The tokens of data after the stable token ``before`` (-1: none)."""
        of, reach, short, fits, size = self.v.of.get, self.reach.get, self.short, self.fits, len(data)
        known = fits.get
        out, at, last, dead = [], 0, before, None
        while at < size:
            for n in reach(data[at : at + 5], short):
                if (t := of(data[at : at + n])) is None or dead and at + n in dead:
                    continue
                if last < 0:
                    break
                if (ok := known(last << 24 | t)) is None:
                    if len(fits) >= self.most:
                        fits.clear()
                    ok = fits[last << 24 | t] = self.v.neighbours(last, t)
                if ok:
                    break
            else:  # nothing fits here: a step back, not to come here again
                dead = dead or set()
                dead.add(at)
                at -= self.length[out.pop()]
                last = out[-1] if out else before
                continue
            out.append(t)
            at, last = at + self.length[t], t
        return out

    def encode(self, data: bytes) -> list[int]:
        return list(self.stream((data,)))

    def stream(self, blocks):
        """Tokens of a pre-token that comes in blocks of bytes, each as soon as it is stable."""
        ahead, length, before, kept, at = self.v.lookahead, self.length, -1, b"", 0
        for block in blocks:
            kept, at = kept[at:] + block, 0
            while len(kept) - at >= 2 * ahead:
                stop = at + ahead
                for t in self.window(kept[at : at + 2 * ahead], before):
                    if at + length[t] > stop:
                        break
                    yield t
                    at, before = at + length[t], t
        if len(kept) > at:
            yield from self.window(kept[at:] if at else kept, before)


#: The pattern of byte-level BPE that splits text before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Encodes texts as the tokenizers library does with the same file.

    Every pre-token goes through the transducer; what it gives is remembered for pre-tokens that aren't long,
    in tables that are emptied when full. ``stream`` takes a text window by window; ``piece`` gives the tokens
    of a piece as ``pieces.Cutter`` cuts them.
    """

    def __init__(self, vocabulary: Vocabulary, most_words: int = 400_000, longest_word: int = 64, window: int = 1 << 16):
        self.v, self.machine, self.at_once = vocabulary, Transducer(vocabulary), window
        self.split = regex.compile(PATTERN).finditer
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocabulary.added, key=len, reverse=True)) + ")").split if vocabulary.added else None
        self.safe = regex.compile(r"(?<=\S) (?=\S)").search
        self.words = _Table(lambda word: tuple(self.machine.encode(word.encode())), most_words, longest_word)
        self.by_library = ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.cutter = Cutter(vocabulary.added)
        self.line = self.words["\n"]

    def _words(self, text: str):
        if text.isascii() or max(text) <= "\u02ff":
            split = (m[0] for m in self.split(text))
        else:  # which characters are letters is up to the library's Unicode version
            split = (text[a:b] for _, (a, b) in self.by_library(text))
        return map(self.words.__getitem__, split)

    def stream(self, text: str):
        """The tokens of a text, a pre-token at a time, from windows that end before a blank between non-blanks."""
        for part in self.special(text) if self.special and any(s in text for s in self.v.added) else [text]:
            if part in self.v.added:
                yield (self.v.added[part],)
                continue
            at = 0
            while at < len(part):
                cut = self.safe(part, at + self.at_once)
                stop = cut.start() if cut else len(part)
                yield from self._words(part[at:stop] if at or cut else part)
                at = stop

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stream(text))) if text else []

    def piece(self, piece: str) -> tuple[int, ...]:
        if piece == END:
            return ()
        lead, body = ("", piece[1:]) if piece[0] == HEAD else ("\n", piece[1:]) if piece[0] == "\n" else (" ", piece)
        before = self.line if lead == "\n" else ()
        if not body:
            return before
        if m := SIMPLE(body):  # a pre-token, and one of marks
            return before + self.words[" " + m[1] if lead == " " else m[1]] + (self.words[m[2]] if m[2] else ())
        return before + tuple(chain.from_iterable(self._words(" " + body if lead == " " else body)))


class _Table(dict):
    """Remembers what ``make`` gives for keys that aren't long. When full, its entries become the old ones, which stay while they are used."""

    def __init__(self, make, most: int, longest: int):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if len(key) > self.longest:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Decoder:
    """Token ids to text: bytes go through an incremental UTF-8 machine; what isn't UTF-8 becomes U+FFFD."""

    def __init__(self, vocabulary: Vocabulary, block: int = 1 << 16):
        self.of, self.block = vocabulary.decoded, block

    def texts(self, data):
        """Parts of the text of bytes that come as one buffer, block by block."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(data), self.block):
            yield machine.decode(data[at : at + self.block])
        yield machine.decode(b"", True)

    def decode(self, ids) -> str:
        machine, of, block = codecs.getincrementaldecoder("utf-8")("replace"), self.of.__getitem__, self.block
        return "".join(machine.decode(b"".join(map(of, ids[at : at + block]))) for at in range(0, len(ids), block)) + machine.decode(b"", True)


class Digester:
    """(number of ids, SHA-256 of the ids as text, SHA-256 of the text decoded from them) of whole texts."""

    def __init__(self, own: Encoder, most: int = 250_000):
        self.own, self.back, self.most = own, Decoder(own.v), most
        self.digits = {i: b"%d," % i for i in own.v.decoded}.__getitem__
        self.known: dict[str, tuple] = {}

    def one(self, text: str) -> tuple[int, str, str]:
        """Of a text that is streamed: a window's tokens and bytes are held at a time."""
        n, ids, out, machine, held, of = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace"), [], self.own.v.decoded
        for t in chain(self.own.stream(text), [None]):
            if t is not None:
                held.extend(t)
            if held and (t is None or len(held) >= 1 << 14):
                ids.update((b"," if n else b"") + b"".join(map(self.digits, held))[:-1])
                out.update(machine.decode(b"".join(map(of.__getitem__, held))).encode())
                n, held = n + len(held), []
        out.update(machine.decode(b"", True).encode())
        return n, ids.hexdigest(), out.hexdigest()

    def _make(self, piece: str) -> tuple[int, bytes, bytes]:
        ids = self.own.piece(piece)
        return len(ids), b"".join(map(self.digits, ids)), b"".join(map(self.own.v.decoded.__getitem__, ids))

    def batch(self, texts: pa.Array, longest: int = 1 << 20) -> tuple[list, list, list]:
        """Of all texts: those without odd places by their pieces, the others and long ones streamed."""
        long = pc.greater(pc.fill_null(pc.binary_length(texts), 0), longest)
        odd, different, indices, offsets = self.own.cutter.cut(pc.if_else(long, "", texts))
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        pieces = different.to_pylist()
        with no_cycles():
            known.update([(p, self._make(p)) for p in pieces if p not in known])
        made = list(map(known.__getitem__, pieces))
        total = np.concatenate([[0], np.cumsum(np.array([m[0] for m in made], np.int64)[indices.to_numpy()])])
        counts = np.diff(total[offsets]).tolist()
        digits_at, digits = joined([m[1] for m in made], indices, offsets)
        text_at, raw = joined([m[2] for m in made], indices, offsets)
        ids_sha, text_sha = [], []
        for a, b, c, d in zip(digits_at[:-1].tolist(), digits_at[1:].tolist(), text_at[:-1].tolist(), text_at[1:].tolist()):
            ids_sha.append(hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest())
            sha = hashlib.sha256()
            for part in self.back.texts(raw[c:d]):
                sha.update(part.encode())
            text_sha.append(sha.hexdigest())
        streamed = np.flatnonzero(odd | long.to_numpy(zero_copy_only=False))
        for i, text in zip(streamed.tolist(), texts.take(pa.array(streamed)).to_pylist()):
            counts[i], ids_sha[i], text_sha[i] = self.one(text)
        return counts, ids_sha, text_sha


def encoder(path: str) -> Encoder:
    """The encoder of a file, one a worker process."""
    return held(("bpe", path), lambda: Encoder(Vocabulary(path)))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text. Null text is empty; empty text has no ids."""
    name = path

    def work(batches):
        own = encoder(name or tokenizer_path())
        for b in slices(batches):
            ids = [own.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Null ids are empty."""
    name = path

    def work(batches):
        own = Decoder(encoder(name or tokenizer_path()).v)
        for b in slices(batches):
            text = [own.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, both digested.

    One pass; ids and decoded texts never leave the worker. Null text is empty: no ids, digests of nothing. Rows
    come out as often as they came in; an empty table gives an empty result.
    """
    name = path

    def work(batches):
        own = held(("digests", name), lambda: Digester(Encoder(Vocabulary(name or tokenizer_path()))))
        for b in blocks(batches, 1):
            n, ids, text = own.batch(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every whole text of documents, encoded and decoded."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
