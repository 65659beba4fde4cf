"""Soft-membership mixing: documents belong to domains by posteriors, and get rates that hit token targets.

A classifier learned from the table of labels gives each document its posteriors over the domains ``clean``,
``low`` (quality 0) and ``toxic``. Rates r >= 0 (and at most ``max_rate``) are fitted so that the expected tokens
of each domain, sum of r * tokens * posterior, match the targets: projected-gradient least squares. In the
metric that weights a document by its tokens, a step is r := clip(r - posterior . (step * gap)), where gap is
totals minus targets and each domain has a step of its own, so that rare ones move as fast as others; Nesterov's
momentum, dropped when the misses grow, takes the next step from beyond r. A document's rate follows from its
posteriors and the past gaps alone. An iteration is one pass that sums a number a domain over all documents; only these come to the driver, and no
rates are kept: a lost executor's are computed again from the gaps.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, held, slices

DOMAINS = ("clean", "low", "toxic")
#: Share of tokens that each domain is to have.
TARGETS = {"clean": 0.95, "low": 0.04, "toxic": 0.01}
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s.,;:!?'\"()-]")
SHAPES = 8


def shape(text: str, words: int, kinds: int) -> np.ndarray:
    """Numbers of a text's form: marks a word, repeated words, digits, length, lines, mean word length, shares of short texts."""
    n = max(1, len(text))
    marks = len(_MARKS.findall(text))
    lines = text.count("\n") + 1
    return np.array([min(2.0, marks / max(1, words)), 1 - kinds / max(1, words), min(1.0, 10 * sum(map(text.count, "0123456789")) / n), np.log1p(words) / 10, min(1.0, words < 20), min(1.0, lines / max(1, words) * 5), min(3.0, n / max(1, words) / 10), min(1.0, text.count("|") / max(1, words))])


class Classifier:
    """Multinomial logistic regression on which known words a text has, and on its form."""

    def __init__(self, words: dict[str, int], weights: np.ndarray, forms: np.ndarray, bias: np.ndarray):
        self.words, self.weights, self.forms, self.bias = words, weights, forms, bias

    def posteriors(self, text: str | None) -> tuple[int, np.ndarray]:
        """(words of the text, posteriors)."""
        found = _WORD.findall((text or "").lower())
        kinds = set(found)
        at = [k for k in map(self.words.get, kinds) if k is not None]
        score = self.bias + shape(text or "", len(found), len(kinds)) @ self.forms
        if at:
            score = score + self.weights[at].sum(0)
        p = np.exp(score - score.max())
        return len(found), p / p.sum()


def train(rows: list[tuple[str, int]], most_words: int = 20_000, steps: int = 250) -> Classifier:
    """Learned from (text, domain number).

    Words count that are in 4 texts or more and whose number in some domain's texts is 4 standard
    deviations from what chance gives, the most telling ``most_words`` of them; so rare words that
    happen to be in one domain aren't learned by heart.
    """
    n = len(DOMAINS)
    sets, forms = [], np.zeros((len(rows), SHAPES))
    for i, (text, _) in enumerate(rows):
        found = _WORD.findall(text.lower())
        sets.append(set(found))
        forms[i] = shape(text, len(found), len(sets[-1]))
    by = [Counter(w for s, (_, k) in zip(sets, rows) if k == d for w in s) for d in range(n)]
    uses = sum(by, Counter())
    share = np.bincount([k for _, k in rows], minlength=n) / max(1, len(rows))
    telling = {}
    for w, c in uses.items():
        if c >= 4:
            expected = c * share
            telling[w] = float(np.max(np.abs(np.array([x[w] for x in by]) - expected) / np.sqrt(expected + 0.5)))
    kept = sorted((w for w, z in telling.items() if z >= 4), key=lambda w: (-telling[w], w))[:most_words]
    words = {w: i for i, w in enumerate(kept)}
    lists = [[words[w] for w in s if w in words] for s in sets]
    doc = np.repeat(np.arange(len(rows)), list(map(len, lists)))
    at = np.array([k for x in lists for k in x], np.int64)
    gold = np.zeros((len(rows), n))
    gold[np.arange(len(rows)), [k for _, k in rows]] = 1
    weight = 1 / max(1, len(rows))
    w, v, b = np.zeros((len(words), n)), np.zeros((SHAPES, n)), np.zeros(n)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v, b)]
    for step in range(1, steps + 1 if len(rows) else 1):
        score = forms @ v + b + (np.stack([np.bincount(doc, w[at, k], len(rows)) for k in range(n)], 1) if len(at) else 0)
        p = np.exp(score - score.max(1, keepdims=True))
        diff = (gold - p / p.sum(1, keepdims=True)) * weight
        gw = np.stack([np.bincount(at, diff[doc, k], len(words)) for k in range(n)], 1) - 2e-5 * w if len(at) else w
        for x, g, (m1, m2) in zip((w, v, b), (gw, forms.T @ diff - 1e-5 * v, diff.sum(0)), state):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            x += 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return Classifier(words, w, v, b)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 3000) -> Classifier:
    """Learned from at most ``train_rows`` labelled documents with text, those of smallest hash of doc_id."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    known = labels.where("doc_id is not null and toxic is not null and quality is not null").groupBy("doc_id").agg(F.max(domain).alias("domain"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # at most train_rows rows of two numbers
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(train_rows).select("text", "domain")
    return train([(r[0], r[1]) for r in rows.collect()])


def posteriors(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, row, tokens, p array<double>) of each row's whole text; row is its xxhash64. Null text is empty: no tokens."""

    def work(batches):
        held("mixing", object)  # another operator's tables make room
        for b in slices(batches):
            found = [classifier.posteriors(t) for t in b.column(2).to_pylist()]
            p = pa.array([x[1].tolist() for x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.int64()), p], ["doc_id", "row", "tokens", "p"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInArrow(work, "doc_id long, row long, tokens long, p array<double>")


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    p = b.column(b.schema.get_field_index("p"))
    return b.column(b.schema.get_field_index("tokens")).to_numpy(zero_copy_only=False).astype(float), np.asarray(p.flatten()).reshape(len(p), -1)


def _free(p: np.ndarray, bounds: bool) -> np.ndarray:
    """Rows whose rate is fitted: all, or with bounds those to which another domain is likelier than clean."""
    return p[:, 0] < p.max(1) if bounds else np.ones(len(p), bool)


def _replay(p: np.ndarray, gaps: np.ndarray, max_rate: float, bounds: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rates, how far the last step took them). gaps: a row a step, the scaled gap by domain and the momentum after it."""
    r = y = np.ones(len(p))
    moved = np.zeros(len(p))
    p = p * _free(p, bounds)[:, None]
    for *g, momentum in gaps:
        new = np.clip(y - p @ np.array(g), 0, max_rate)
        moved = np.abs(new - y)
        r, y = new, new + momentum * (new - r)
    return r, moved


def _totals(scored: DataFrame, gaps: np.ndarray, max_rate: float, bounds: bool) -> tuple[np.ndarray, ...]:
    """By domain, under the rates that the gaps lead to: expected tokens, tokens that the last step moved, tokens
    whose rates are free; and the matrices of sum tokens * p * p' of all rows and of the free ones."""
    n = len(DOMAINS)

    def work(batches):
        for b in batches:
            tokens, p = _arrays(b)
            if len(p):
                rate, moved = _replay(p, gaps, max_rate, bounds)
                free = tokens * _free(p, bounds)
                sums = [(tokens * rate) @ p, (free * moved) @ p, free @ p, *((p * x[:, None]).T @ p for x in (tokens, free))]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for x in sums for v in x.ravel()], names)

    names = [f"s{k}" for k in range(3 * n + 2 * n * n)]
    row = scored.select("tokens", "p").mapInArrow(work, ", ".join(f"{x} double" for x in names)).agg(*(F.sum(x) for x in names)).head()
    sums = np.array([x or 0.0 for x in row])
    return *sums[: 3 * n].reshape(3, n), *sums[3 * n :].reshape(2, n, n)


def fit_rates(scored: DataFrame, targets: dict[str, float], max_rate: float, steps: int = 500, close: float = 1e-3, still: float = 1e-4, bounds: bool = False) -> np.ndarray:
    """The steps whose replay gives the rates.

    Stops when each domain's total is within ``close`` of its target, or else where rates are best: when a
    step moves no more than ``still`` of any domain's tokens. Warns when ``steps`` don't lead there. With bounds,
    targets of domains other than clean are the most they may have beside all clean tokens, and rows that are
    likeliest clean keep a rate of 1.
    """
    gaps = np.zeros((0, len(DOMAINS) + 1))
    now, _, loose, gram, free = _totals(scored, gaps, max_rate, bounds)
    share = np.array([targets[d] for d in DOMAINS])
    if now.sum() <= 0 or loose.sum() <= 0:
        return gaps
    # the most tokens that no domain needs more of than it can give
    budget = min(now.sum(), *(now[share > 0] * max_rate / share[share > 0]))
    goal = share * budget
    if bounds:
        goal = np.minimum(now, share * now[0] / share[0])
    scale = 1 / np.maximum(np.diag(gram), 1e-9 * gram.max())
    root = np.sqrt(scale)
    scale /= max(np.linalg.eigvalsh(free * np.outer(root, root))[-1], 1e-12)
    ahead, speed, last, moved = now, 1.0, np.inf, np.full(len(DOMAINS), np.inf)
    for _ in range(steps):
        if (np.abs(now - goal) <= close * goal).all() or (moved <= still * loose).all():
            return gaps
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        gaps = np.vstack([gaps, [*(scale * (ahead - goal)), 0.0]])
        new, moved, *_ = _totals(scored, gaps, max_rate, bounds)
        miss = float(scale @ (new - goal) ** 2)
        if miss > last:
            faster, momentum = 1.0, 0.0
        else:
            momentum = (speed - 1) / faster
        gaps[-1, -1] = momentum
        ahead, now, speed, last = new + momentum * (new - now), new, faster, miss
    if not ((np.abs(now - goal) <= close * goal).all() or (moved <= still * loose).all()):
        warnings.warn(f"rates haven't converged in {steps} steps: totals {now.tolist()}, targets {goal.tolist()}", RuntimeWarning, stacklevel=2)
    return gaps


def rates(scored: DataFrame, gaps: np.ndarray, max_rate: float, bounds: bool = False) -> DataFrame:
    """``scored`` with each row's rate."""

    def work(batches):
        for b in batches:
            _, p = _arrays(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_replay(p, gaps, max_rate, bounds)[0], pa.float64())], [*b.schema.names, "rate"])

    kinds = ", ".join(f"{c} {t}" for c, t in scored.dtypes)
    return scored.mapInArrow(work, f"{kinds}, rate double")


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = 4.0, bounds: bool = False) -> DataFrame:
    """(doc_id, row, tokens, p, rate, copies) of each row: how often it is to be used in expectation, and how often it is.

    copies rounds rate up or down by a hash of doc_id, so it keeps the expectation. Empty texts have no
    tokens, and rates of their posteriors like others. With no labels all domains are equally likely. An
    empty table gives an empty result.
    """
    work = Workspace(spark, "mixing")
    scored = work.table(posteriors(docs, fit(docs, labels)), "scored")
    out = rates(scored, fit_rates(scored, targets, max_rate, bounds=bounds), max_rate, bounds)
    luck = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11) / F.lit(float(1 << 53))
    return out.withColumn("copies", F.floor(F.round("rate", 9) + luck).cast("long"))


def keep_mixed(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` without the low-quality and toxic text beyond its share: rates of 1 at most, rows of no copy go, others stay once.

    The shares of low and toxic are upper bounds, so rows that are likeliest clean stay at every mix, and with
    no labels all do. Rows are told apart by doc_id and text; null doc_ids stay.
    """
    mixed = mix(spark, docs, labels, targets, max_rate=1.0, bounds=True)
    gone = mixed.where("copies = 0").select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    own = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row"))
    return own.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left_anti").select("own.*")


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, posteriors, rate and copies."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = mix(spark, docs, labels)
    return out.select("doc_id", "tokens", *(F.round(F.get("p", F.lit(k)), 6).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), F.round("rate", 6).alias("rate"), "copies")
