"""Language ID by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes of 1 to 3 bytes, its n-grams of 2 to 4 bytes, and lexicon entries (languages that most uses of the word in the training sample have); all but the
lexicon are hashed. Emission weights of the features, transitions between the languages of neighbouring
words, and start weights are learned together by gradient ascent on the conditional log-likelihood. Chains are
lines. Posteriors by forward-backward label every word, so texts that switch language are told word by word;
a document's language is that of the largest mean posterior, which is its score.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of, held, slices

BITS = 15
NONE = "und"
RUN = 12  # words that a chain of training takes from one text

START, STOP = "\x02", "\x03"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of all byte n-grams, n from 2 to 4, of the lower-cased words with start and stop marks.

    Those with a mark are the words' prefixes and suffixes of 1 to 3 bytes. All words are hashed at once.
    """
    joined = START + (STOP + START).join(words) + STOP
    if joined.count(START) != len(words) or joined.count(STOP) != len(words):
        joined = START + (STOP + START).join(w.replace(START, " ").replace(STOP, " ") for w in words) + STOP
    text = np.frombuffer(joined.lower().encode(), np.uint8).astype(np.uint32)
    owner = np.cumsum(text == ord(START)) - 1
    h, buckets, owners = text, [], []
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(0x01000193) + text[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append(((h[inside] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS))
        owners.append(owner[: len(h)][inside])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


class Model:
    """Learned weights; plain arrays and a bounded lexicon, so it travels with a task."""

    def __init__(self, languages: list[str], weights: np.ndarray, lexicon: dict[str, int], lexicon_weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.languages, self.weights, self.lexicon, self.lexicon_weights, self.moves, self.start = languages, weights, lexicon, lexicon_weights, moves, start

        self.key = zlib.crc32(weights.tobytes() + moves.tobytes())

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log weights (words x languages)."""
        at, owner = features(words)
        out = np.stack([np.bincount(owner, w[at], len(words)) for w in self.weights.T], 1)
        known = [(i, k) for i, w in enumerate(words) if (k := self.lexicon.get(w.lower())) is not None]
        if known:
            at, k = map(list, zip(*known))
            out[at] += self.lexicon_weights[k]
        return out


def forward_backward(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors (words x languages) of chains that lie one after another in ``emission`` (log weights).

    All chains take a step at once, longest first; values are scaled at each step. With pairs: also the
    expected number of moves between languages, posteriors of first words, and the log-likelihood's norm.
    """
    order = np.argsort(-lengths, kind="stable")
    lens = lengths[order]
    first = (np.concatenate([[0], np.cumsum(lengths)[:-1]]))[order]
    top = emission.max(1, keepdims=True)
    e, move = np.exp(emission - top), np.exp(moves)
    alpha, scale = np.empty_like(e), np.empty(len(e), e.dtype)
    live = np.searchsorted(-lens, -np.arange(1, (lens[0] if len(lens) else 0) + 1), side="right")
    for t, m in enumerate(live):
        at = first[:m] + t
        a = e[at] * (np.exp(start) if t == 0 else alpha[at - 1] @ move)
        s = a.sum(1)
        alpha[at], scale[at] = a / s[:, None], s
    beta = np.ones_like(e)
    expected = np.zeros_like(move)
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        x = e[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = x @ move.T
        if pairs:
            expected += (alpha[at - 1].T @ x) * move
    posterior = alpha * beta
    posterior /= posterior.sum(1, keepdims=True)
    if pairs:
        return posterior, expected, posterior[first].sum(0), float(np.log(scale).sum() + top.sum())
    return posterior


def draw_runs(text: str, words: int) -> list[list[str]]:
    """Runs of ``RUN`` neighbouring words from anywhere in a text, of about ``words`` words in all: those of smallest hash."""
    own = text.split()
    runs = [own[i : i + RUN] for i in range(0, len(own), RUN)]
    most = max(2, words // RUN)
    if len(runs) > most:
        kept = sorted(range(len(runs)), key=lambda i: (zlib.crc32(f"{i} {' '.join(runs[i])}".encode()), i))[:most]
        runs = [runs[i] for i in sorted(kept)]
    return runs


def train(found: list[tuple[str, list[str]]], steps: int = 60, seed: int = 7) -> Model | None:
    """A model of (language, run of words) of texts that have one language each.

    So that moves between languages are learned too, chains are made of runs of different texts. The sample must
    come in an order of its own, as the chains follow from it.
    """
    languages = sorted({lang for lang, _ in found})
    if not languages:
        return None
    runs: list[tuple[int, list[str]]] = [(languages.index(lang), run) for lang, run in found]
    rng = np.random.default_rng(seed)
    runs = [runs[i] for i in rng.permutation(len(runs))]
    tokens = [w for _, r in runs for w in r]
    labels = np.array([k for k, r in runs for _ in r], np.int64)
    if not tokens:
        return None
    chains = np.array([sum(len(r) for _, r in runs[i : i + 4]) for i in range(0, len(runs), 4)])
    kinds = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
    at = np.array([kinds[w] for w in tokens])
    n, dim = len(languages), 1 << BITS
    uses: dict[str, Counter] = {}
    for w, k in zip(tokens, labels.tolist()):
        uses.setdefault(w.lower(), Counter())[k] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in uses.items() if c.total() >= 3 and max(c.values()) >= 0.7 * c.total()}
    flat, owner = features(list(kinds))
    named = [(i, dim + lexicon[w.lower()]) for w, i in kinds.items() if w.lower() in lexicon]
    owner = np.concatenate([owner, np.array([i for i, _ in named], np.int64)])
    flat = np.concatenate([flat, np.array([k for _, k in named], np.int64)])
    gold = np.zeros((len(tokens), n), np.float32)
    gold[np.arange(len(tokens)), labels] = 1
    heads = np.concatenate([[0], np.cumsum(chains)[:-1]])
    inner = np.ones(len(tokens), bool)
    inner[heads] = False
    seen = np.zeros((n, n))
    np.add.at(seen, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    # one vector of all parameters: features, lexicon, moves, start
    size = (dim + n) * n
    p = np.zeros(size + n * n + n, np.float64)
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w = p[:size].reshape(-1, n)
        kind_score = np.stack([np.bincount(owner, w[flat, k], len(kinds)) for k in range(n)], 1).astype(np.float32)
        post, pairs, begun, _ = forward_backward(kind_score[at], chains, p[size:-n].reshape(n, n).astype(np.float32), p[-n:].astype(np.float32), pairs=True)
        g = np.zeros_like(p)
        diff = gold - post
        by_kind = np.stack([np.bincount(at, diff[:, k], len(kinds)) for k in range(n)], 1)
        g[:size] = np.stack([np.bincount(flat, by_kind[owner, k], dim + n) for k in range(n)], 1).ravel()
        g[size:-n] = (seen - pairs).ravel()
        g[-n:] = np.bincount(labels[heads], minlength=n) - begun
        g = g / len(tokens) - 1e-6 * p
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        p += 0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    w = p[:size].reshape(-1, n).astype(np.float32)
    return Model(languages, w[:dim], lexicon, w[dim:], p[size:-n].reshape(n, n).astype(np.float32), p[-n:].astype(np.float32))


def held_out():
    return crc32_of(F.col("doc_id")) % 5 == 0


def fit(docs: DataFrame, train_rows: int = 1500, words: int = 160_000) -> Model | None:
    """A model learned from at most ``train_rows`` rows with text and language that aren't held out.

    They are those of smallest hash of doc_id, ties by language and text, so the sample is the same whatever the
    partitions. Of each row runs of words are drawn by hash from all of its text, about ``words`` words in all, where
    the text lies: only these come to the driver. Only text and lang are used.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    ids = rows.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(train_rows)
    last, n = ids.agg(F.max("h"), F.count(F.lit(1))).head()
    if last is None:
        return None
    share = words // n
    sample = rows.where(F.xxhash64("doc_id") <= last).orderBy(F.xxhash64("doc_id"), "lang", F.xxhash64("text")).limit(train_rows).select("text", "lang")

    def work(batches):
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs = draw_runs(text, share)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), pa.array(runs, pa.list_(pa.string()))], ["lang", "run"])

    drawn = sample.mapInArrow(work, "lang string, run array<string>").collect()  # ``words`` words, or two runs a row
    return train(sorted((r[0], list(r[1])) for r in drawn))


def _predictor(model: Model):
    """The predictor of a model, one a worker process."""
    return held(("crf", model.key), lambda: _make_predictor(model))


def _make_predictor(model: Model, most: int = 250_000, words_at_once: int = 200_000):
    known: dict[str, int] = {}
    table = np.zeros((most + words_at_once, len(model.languages)), np.float32)

    def index(words: list[str]) -> np.ndarray:
        nonlocal table
        new = list(set(words).difference(known))
        if len(known) + len(new) > most:
            known.clear()
            new = list(set(words))
        if new:
            at = len(known)
            if at + len(new) > len(table):
                table = np.concatenate([table, np.zeros((len(new), table.shape[1]), table.dtype)])
            table[at : at + len(new)] = model.emissions(new)
            known.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def some(texts: list[str | None]) -> list[tuple[str, float]]:
        chains, counts, words = [], [], []
        for t in texts:
            n = 0
            if t and any(map(str.isalpha, t)):
                for line in t.split("\n"):
                    own = line.split()
                    if own:
                        words += own
                        chains.append(len(own))
                        n += len(own)
            counts.append(n)
        if not words:
            return [(NONE, 0.0)] * len(texts)
        at = index(words)
        post = forward_backward(table[at], np.array(chains), model.moves, model.start)
        filled = np.array(counts) > 0
        ends = np.cumsum(counts)
        sums = np.add.reduceat(post.astype(np.float64), (ends - counts)[filled], axis=0) / np.array(counts)[filled][:, None]
        best = sums.argmax(1)
        told = iter(zip(best.tolist(), sums[np.arange(len(best)), best].tolist()))
        return [(model.languages[(x := next(told))[0]], min(1.0, x[1])) if c else (NONE, 0.0) for c in counts]

    def predict(texts):
        held: list = []
        size = 0
        out: list[tuple[str, float]] = []
        for t in texts:
            held.append(t)
            size += len(t or "") // 5
            if size >= words_at_once:
                out += some(held)
                held, size = [], 0
        return out + some(held) if held else out

    return predict


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text.

    ``und`` with score 0 where text is null or has no letter (``str.isalpha``), or where there was nothing to learn
    from. Of languages that are as likely the first in order is told. doc_id is carried along only: repeated rows and
    null doc_ids come out as they came in. An empty table gives an empty result.
    """

    def work(batches):
        predict = _predictor(model) if model else (lambda texts: [(NONE, 0.0)] * len(texts))
        for b in slices(batches):
            found = predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language isn't told with ``least`` mean posterior or that have no letter.

    Where ``docs`` has a column lang, rows without one get the language that is told; labels that are there stay. All
    other columns are carried along; the decision is taken row by row, in one pass. An empty table gives an empty result.
    """
    model = fit(docs)
    names = docs.columns
    at, lang = names.index("text"), names.index("lang") if "lang" in names else None

    def work(batches):
        predict = _predictor(model) if model else (lambda texts: [(NONE, 0.0)] * len(texts))
        for b in slices(batches):
            found = predict(b.column(at).to_pylist())
            if lang is not None and b.column(lang).null_count:
                told = pc.coalesce(b.column(lang), pa.array([x[0] for x in found], b.column(lang).type))
                b = b.set_column(lang, b.schema.field(lang), told)
            yield b.filter(pa.array([name != NONE and score >= least for name, score in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op6_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the language of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
