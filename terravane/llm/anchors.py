"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint is cut into blocks. In each block the anchors are the words of a linear covering code: the perfect
Hamming code on the first 15 bits beside all words of the others, of covering radius 1. A fingerprint is *at home*
at one anchor within the covering radius, and is replicated to every anchor within covering radius plus block
threshold, 1. So of two fingerprints whose block differs in at most 1 bit, either is replicated to the home anchor of
the other, and comparing homes with replicas per anchor finds the pair.

``links`` finds all pairs that differ in at most 4 of 64 bits, exactly: of three blocks (21, 21 and 22 bits) one differs
in at most ``floor(4 / 3)`` = 1 bit. ``similar`` finds texts whose shingle sets are similar to a share: such sets'
SimHash bits differ with a known chance, so it takes longer fingerprints. There a text is at its home of each block only,
without replicas: texts whose blocks have the same home meet. The anchors of a block are about as many as the texts
(an anchor then has about as many rows at every size), the blocks as many as the wanted recall needs: for 0.999 a
text has 43 rows at 236,000 texts and 121 at 15 million, where replicas took 103 and 445 for 0.98. Candidates are
confirmed by the exact similarity of both sets.

Anchors of many rows are split into cells of homes and replicas, so that no task holds or compares them all.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, connected_components, held, slices

THRESHOLD = 4
#: Blocks of a fingerprint: word, lowest bit, bits.
BLOCKS = ((0, 0, 21), (0, 21, 21), (0, 42, 22))
HAMMING = 15
RADIUS = 1
#: Rows of one anchor above which it is split.
CROWD = 20_000
#: Rows of a sieve at most, of 64 bits each.
SIEVE = 1 << 18


def _words(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of the ``width``-word shingles of a text, repeats included; none where it has no word.

    Words are runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z; a text of fewer
    words has one shingle, all its words.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, last = (ends - lengths)[:n], ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), last.tolist())], np.uint64)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """By bit: in how many of the hashes (n x words) it is set."""
    n, w = hashes.shape
    votes = np.zeros(64 * w, np.int64)
    whole = n // 255 * 255
    for at in range(0, whole, 255 * 64):  # 255 bits can't overflow a byte
        bits = np.unpackbits(hashes[at : min(whole, at + 255 * 64)].view(np.uint8).reshape(-1, 8 * w), axis=1, bitorder="little")
        votes += np.add.reduce(bits.reshape(-1, 255, 64 * w), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    if whole < n:
        votes += np.add.reduce(np.unpackbits(hashes[whole:].view(np.uint8).reshape(-1, 8 * w), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return votes


def _majority(votes: np.ndarray, n: int) -> np.ndarray:
    """Words of the bits that are set in over half of n hashes."""
    return np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)


def simhash64(text: str | None, width: int, seed: int) -> int:
    """Unsigned SimHash of the shingles of a text, repeats included; 0 where it has no word."""
    hashes = _words(text, width, seed)
    return int(_majority(_votes(hashes[:, None]), len(hashes))[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null text counts as empty."""

    def work(batches):
        held("anchors", object)
        for b in slices(batches):
            fp = np.array([simhash64(t, width, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fp long")


def _syndrome(block):
    """Of the first 15 bits of a block: XOR of the one-based positions of its set bits."""
    out = F.lit(0)
    for j in range(HAMMING):
        out = out.bitwiseXOR((F.shiftright(block, j).bitwiseAND(F.lit(1)) * (j + 1)).cast("int"))
    return out


def _patterns(bits: int, within: int) -> list[list[int]]:
    """By syndrome: the error patterns of weight up to ``within`` that lead from a word to an anchor."""
    out: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    for weight in range(within + 1):
        for at in itertools.combinations(range(bits), weight):
            s = 0
            for j in at:
                s ^= j + 1 if j < HAMMING else 0
            out[s].append(sum(1 << j for j in at))
    return out


def replicas(fps: DataFrame, blocks=BLOCKS, keep: tuple[str, ...] = (), homes: bool = False) -> DataFrame:
    """(anchor, home, node, fp, keep) for every anchor within covering radius plus block threshold of each block.

    fps: (node, words array<long>, keep); fp is the first word. home is 1 at one anchor of each block; with homes
    only these come out.
    """
    if homes and len({b for _, _, b in blocks}) == 1:
        return _homes(fps, blocks, keep)
    tables = {bits: _patterns(bits, RADIUS + 1) for bits in {b for _, _, b in blocks}}
    parts = []
    for k, (word, low, bits) in enumerate(blocks):
        block = F.shiftrightunsigned(F.get("words", F.lit(word)), low).bitwiseAND(F.lit((1 << bits) - 1))
        table = F.array(*(F.array(*(F.lit(e).cast("long") for e in own[: 1 if homes else None])) for own in tables[bits]))
        parts.append(F.transform(F.get(table, _syndrome(block)), _anchor(block, F.lit(k << 40).cast("long"))))
    out = fps.select("node", F.get("words", F.lit(0)).alias("fp"), *keep, F.explode(F.concat(*parts)).alias("x"))
    return out.select(F.shiftright("x", 1).alias("anchor"), F.col("x").bitwiseAND(F.lit(1)).cast("int").alias("home"), "node", "fp", *keep)


def _homes(fps: DataFrame, blocks, keep: tuple[str, ...]) -> DataFrame:
    """Homes of ``replicas`` for blocks of equal length, a row for each block before anything is computed: many blocks in one row make code that the JVM doesn't compile."""
    bits = blocks[0][2]
    words, lows = (F.array(*(F.lit(b[i]) for b in blocks)) for i in (0, 1))
    errors = F.array(*(F.lit(own[0]).cast("long") for own in _patterns(bits, RADIUS)))
    own = fps.select("node", "words", *keep, F.explode(F.array(*(F.lit(k) for k in range(len(blocks))))).alias("block_no"))
    block = F.call_function("shiftrightunsigned", F.get("words", F.get(words, "block_no")), F.get(lows, "block_no")).bitwiseAND(F.lit((1 << bits) - 1))
    own = own.select("node", F.get("words", F.lit(0)).alias("fp"), *keep, "block_no", block.alias("block"))
    anchor = F.col("block").bitwiseXOR(F.get(errors, _syndrome(F.col("block")))) + F.shiftleft(F.col("block_no").cast("long"), 40)
    return own.select(anchor.alias("anchor"), F.lit(1).alias("home"), "node", "fp", *keep)


def _anchor(block, mark):
    """An error pattern of a block, and whether it is the first (the home's), to the number of its anchor."""
    return lambda e, i: F.shiftleft(block.bitwiseXOR(e) + mark, 1).bitwiseOR(F.when(i == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))


def _cells(work: Workspace, name: str, fps: DataFrame, blocks, keep: tuple[str, ...], most: int, only_homes: bool) -> DataFrame:
    """``replicas`` with cell: anchors of over ``most`` homes are cut into c x c cells of homes by replicas.

    A home goes to the c cells of its row, a replica to the c of its column; homes are replicas too.
    """
    rows = replicas(fps, blocks, keep, only_homes)
    crowds = replicas(fps, blocks, homes=True).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    crowds = work.table(crowds.select("anchor", F.ceil(F.col("n") / most).cast("int").alias("c")), f"{name}-crowds")
    if not crowds.head(1):
        return rows.withColumn("cell", F.lit(0))
    mine = F.pmod(F.xxhash64("node"), F.col("c")).cast("int")
    every = F.sequence(F.lit(0), F.col("c") - 1)
    as_home = F.transform(every, lambda j: F.struct((mine * F.col("c") + j).alias("cell"), F.lit(1).alias("home")))
    as_replica = F.transform(every, lambda i: F.struct((i * F.col("c") + mine).alias("cell"), F.lit(0).alias("home")))
    places = F.when(F.col("c").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.col("home").alias("home")))).when(F.col("home") == 1, F.concat(as_home, as_replica)).otherwise(as_replica)
    rest = [c for c in rows.columns if c != "home"]
    return rows.join(crowds, "anchor", "left").select(*rest, F.explode(places).alias("p")).select(*rest, "p.cell", "p.home")


def _forest(u: np.ndarray, v: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spanning forest of the edges of fewest differing bits, so that dense groups don't come out as all their pairs.

    Edges of equal bits are taken in order of their ends. As that order is the same in every cell, cells with the
    same texts take the same edges, which are one in the end.
    """
    root: dict[int, int] = {}

    def find(x):
        while (p := root.get(x, x)) != x:
            root[x] = x = root.get(p, p)
        return x

    order, kept = np.lexsort((v, u, off)), []
    for k, a, b in zip(order.tolist(), u[order].tolist(), v[order].tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            kept.append(k)
    return u[kept], v[kept], off[kept]


def _spans(first: np.ndarray, end: np.ndarray, most: int):
    """Index arrays of the pairs (k, first[k] .. end[k] - 1), so many at a time."""
    n = np.maximum(0, end - first)
    total = np.concatenate([[0], np.cumsum(n)])
    for at in range(0, int(total[-1]), most):
        k = np.arange(at, min(at + most, int(total[-1])))
        i = np.searchsorted(total, k, side="right") - 1
        yield i, first[i] + k - total[i]


def _compare(key, home, node, words, limit: int, most: int = 1 << 18):
    """(u, v): a spanning forest of the pairs of equal (adjacent) keys, homes with all others, that differ in ``limit`` bits or fewer."""
    order = np.lexsort((-home, key))
    key, home, node, words = key[order], home[order], node[order], [w[order] for w in words]
    homes = np.flatnonzero(home)
    end = np.searchsorted(key, key[homes], side="right")
    held, n, bound = [], 0, most

    def reduced():
        return _forest(*(np.concatenate(x) for x in zip(*held)))

    for i, b in _spans(homes + 1, end, most):
        a = homes[i]
        off = np.zeros(len(a), np.int64)
        for w in words:
            off += np.bitwise_count(w[a] ^ w[b])
        ok = (off <= limit) & (node[a] != node[b])
        if ok.any():
            u, v = node[a[ok]], node[b[ok]]
            held.append((np.minimum(u, v), np.maximum(u, v), off[ok]))
            n += len(u)
        if n > bound:
            held = [reduced()]
            n = len(held[0][0])
            bound = max(most, 2 * n)
    return reduced()[:2] if held else None


def _pairs(work: Workspace, name: str, fps: DataFrame, blocks, limit: int, extra: tuple[str, ...] = (), most: int = CROWD, only_homes: bool = False) -> DataFrame:
    """(u, v) of nodes that meet at an anchor and differ in at most ``limit`` bits of fp and ``extra``, u the smaller; fps as of ``replicas``.

    A task sees the rows of its cells in order, a batch at a time. Only a spanning forest of each cell's pairs comes
    out: fewer rows than the cell has, and it joins all that its pairs join.
    """

    def run(batches):
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            goes_on = held and all(held[-1][k][-1] == now[k][-1] for k in (0, 1))
            held.append(now)
            if goes_on:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = 1 + int(np.flatnonzero((cols[0][:-1] != cols[0][-1]) | (cols[1][:-1] != cols[1][-1]))[-1]) if (cols[0][0], cols[1][0]) != (cols[0][-1], cols[1][-1]) else 0
            yield from found([c[:cut] for c in cols])
            held = [[c[cut:].copy() for c in cols]]
        if held:
            yield from found([np.concatenate(c) for c in zip(*held)])

    def found(cols):
        anchor, cell, home, node, *rest = cols
        if len(anchor):
            key = np.cumsum(np.concatenate([[False], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]))
            if (kept := _compare(key, home, node, [c.view(np.uint64) for c in rest], limit)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1])], ["u", "v"])

    rows = _cells(work, name, fps, blocks, extra, most, only_homes)
    dealt = rows.select("anchor", "cell", "home", "node", "fp", *extra).repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def links(fps: DataFrame, most: int = CROWD, work: Workspace | None = None) -> DataFrame:
    """(u, v): spanning forests of all pairs of different fingerprints (fp) that differ in 1 to 4 bits."""

    work = work or Workspace(fps.sparkSession, "links")
    return _pairs(work, "links", fps.select(F.col("fp").alias("node"), F.array("fp").alias("words")), BLOCKS, THRESHOLD, most=most)


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text, others are ignored).

    Fingerprints link at up to 4 differing bits; component_id is the smallest doc_id that links reach.
    Null and empty texts, and texts without a word, have fingerprint 0 and link like any other. Rows
    with null doc_id keep their fingerprint and take the component of their fingerprint's other rows,
    null if there are none. Repeated rows come out as often as they came in. An empty table gives an
    empty result.
    """
    work = Workspace(spark, "anchors")
    marked = work.table(fingerprints(docs, width, seed), "fingerprints")
    different = work.table(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "different")
    edges = work.table(links(different.select("fp"), work=work), "links")
    labels = connected_components(work, edges)
    joined = different.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = work.table(joined.join(smallest, "label").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def chance(similarity: float) -> float:
    """Chance that a SimHash bit of two sets of that Jaccard similarity differs, at most: that of sets of equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(n: int, similarity: float, recall: float = 0.999) -> list[tuple[int, int, int]]:
    """Blocks of a long fingerprint by which two sets of that similarity among n have the same home in one with the chance ``recall``.

    A block has 16 words a home on its first 15 bits, so n texts have 64 to 128 rows an anchor; less below 2^18 texts.
    Two words have the same home where they are equal, and else where their difference is that of 2 of the 16 errors:
    for each difference of 1 or 2 of the 15 bits, 2 of 16 words have such errors. Other bits must be equal.
    """
    bits = min(32, max(HAMMING, math.ceil(math.log2(max(2, n))) - 3))
    p = chance(similarity)
    q = 1 - p
    one = (q**HAMMING + (HAMMING * p * q ** (HAMMING - 1) + math.comb(HAMMING, 2) * p**2 * q ** (HAMMING - 2)) / 8) * q ** (bits - HAMMING)
    number = math.ceil(math.log(1 - recall) / math.log(1 - one))
    per_word = 64 // bits
    return [(k // per_word, k % per_word * bits, bits) for k in range(number)]


def shingle_set(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted different XXH64 of a text's shingles."""
    return np.unique(_words(text, width, seed))


def _long_fingerprint(own: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set in so many words: each shingle's hash is mixed anew for each word (SplitMix64)."""
    votes = np.zeros(64 * words, np.int64)
    salt = (np.arange(words, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(own), 1 << 14):
        x = own[at : at + (1 << 14), None] + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        votes += _votes(np.ascontiguousarray(x ^ (x >> np.uint64(31))))
    return _majority(votes, len(own))


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _marks(docs: DataFrame, words: int, width: int, seed: int) -> DataFrame:
    """(doc_id, row, node, size, words) of every row; row: a hash of its text, node: of its set, words: the set's fingerprint."""

    def work(batches):
        held("anchors", object)  # another operator's tables make room
        for b in slices(batches):
            sets = [shingle_set(t, width, seed) for t in b.column(2).to_pylist()]
            fps = np.array([_long_fingerprint(s, words) for s in sets], np.uint64).reshape(-1, words).view(np.int64)
            own = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * words, pa.int32()), pa.array(fps.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_digests(sets)), pa.array(list(map(len, sets)), pa.int64()), own], ["doc_id", "row", "node", "size", "words"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInArrow(work, "doc_id long, row long, node long, size long, words array<long>")


def _sieve(rows: DataFrame) -> DataFrame:
    """(word, bits): a bit for each row (a hash) of ``rows``, in at most ``SIEVE`` words at every size."""
    word, bit = F.pmod("row", F.lit(SIEVE)).alias("word"), F.expr("bit_or(shiftleft(1L, cast(shiftright(row, 32) & 63 as int)))")
    return rows.groupBy(word).agg(bit.alias("bits"))


def _sifted(df: DataFrame, sieve: DataFrame) -> DataFrame:
    """``df`` with passes: false only where a sieve's rows surely don't have its row, so that texts needn't be dealt out to tell."""
    found = df.join(F.broadcast(sieve), F.pmod("row", F.lit(SIEVE)) == F.col("word"), "left")
    return found.select(*df.columns, F.expr("coalesce(shiftright(bits, cast(shiftright(row, 32) & 63 as int)) & 1 = 1, false)").alias("passes"))


def _sets(docs: DataFrame, rows: DataFrame, width: int, seed: int) -> DataFrame:
    """(node, own): the sets of the nodes of ``rows`` (node, row), row a hash of a text that has the set."""

    def sets_of(batches):
        for b in slices(batches):
            sets = [shingle_set(t, width, seed) for t in b.column(0).to_pylist()]
            own = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(_digests(sets)), own], ["node", "own"])

    texts = _sifted(docs.select("text", F.xxhash64("text").alias("row")), _sieve(rows)).where("passes").select("text", "row").join(rows.select("row"), "row", "left_semi")
    return texts.groupBy("row").agg(F.first("text").alias("text")).select("text").mapInArrow(sets_of, "node long, own array<long>").dropDuplicates(["node"])


def _exact_links(nodes: np.ndarray, side: np.ndarray, words: np.ndarray, sets: list[np.ndarray], share: tuple[int, int], limit: int, block: int = 128):
    """A spanning forest of the pairs whose sets are as similar as share[0] / share[1], as (u, v).

    Pairs are tried in blocks, those of few differing bits first, and only while they aren't joined yet. With two
    sides only pairs across them are tried.
    """
    n, size = len(nodes), np.array([len(s) for s in sets])
    root, kept = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    across = len(np.unique(side)) > 1
    for at in range(0, n, block):
        own = slice(at, min(n, at + block))
        off = np.zeros((own.stop - at, n - at), np.uint16)
        for w in range(words.shape[1]):
            off += np.bitwise_count(words[own, w, None] ^ words[None, at:, w])
        ok = (off <= limit) & (np.minimum(size[own, None], size[None, at:]) * share[1] >= np.maximum(size[own, None], size[None, at:]) * share[0])
        ok &= np.arange(n - at)[None, :] > np.arange(own.stop - at)[:, None]
        if across:
            ok &= side[own, None] != side[None, at:]
        i, j = np.nonzero(ok)
        order = np.argsort(off[i, j], kind="stable")
        for a, b in zip((i[order] + at).tolist(), (j[order] + at).tolist()):
            x, y = find(a), find(b)
            if x != y:
                small, large = (sets[a], sets[b]) if size[a] < size[b] else (sets[b], sets[a])
                found = np.searchsorted(large, small)
                common = int((large[np.minimum(found, len(large) - 1)] == small).sum())
                if common * sum(share) >= (len(small) + len(large)) * share[0]:
                    root[max(x, y)] = min(x, y)
                    kept.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
    return kept


def _linked(work: Workspace, members: DataFrame, share: tuple[int, int], limit: int, most: int) -> DataFrame:
    """(u, v): links of the members (cluster, node, words, own), found within clusters.

    Clusters of over ``most`` members are cut into chunks, and each two chunks meet in a cell, so that no task holds a
    whole large cluster. Only a spanning forest of a cell's links comes out.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    sizes = work.table(sizes.select("cluster", F.ceil(F.col("n") / most).cast("int").alias("c")), "crowds")
    if sizes.head(1):
        mine = F.pmod(F.xxhash64("node"), F.col("c")).cast("int")
        cells = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda k: F.struct((F.least(mine, k) * F.col("c") + F.greatest(mine, k)).alias("cell"), F.when(mine < k, 0).when(mine > k, 1).otherwise(0).alias("side")))
        one = F.array(F.struct(F.lit(0).alias("cell"), F.lit(0).alias("side")))
        members = members.join(sizes, "cluster", "left").withColumn("p", F.explode(F.when(F.col("c").isNull(), one).otherwise(cells)))
        members = members.select("cluster", "p.cell", "p.side", "node", "words", "own")
    else:
        members = members.select("cluster", F.lit(0).alias("cell"), F.lit(0).alias("side"), "node", "words", "own")

    def run(batches):
        key, rows = None, []

        def done():
            kept = _exact_links(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]).view(np.uint64), [r[3].view(np.uint64) for r in rows], share, limit)
            if kept:
                u, v = zip(*kept)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            sets, words = b.column(5), b.column(4)
            for i, (cluster, cell, side, node) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
                if (cluster, cell) != key:
                    if len(rows) > 1:
                        yield from done()
                    key, rows = (cluster, cell), []
                rows.append((node, side, words[i].values.to_numpy(zero_copy_only=False), sets[i].values.to_numpy(zero_copy_only=False).copy()))
        if len(rows) > 1:
            yield from done()

    return members.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell").mapInArrow(run, "u long, v long").distinct()


def _limit(p: float, words: int) -> int:
    """Differing bits of so many words, four deviations above the mean for bits that differ with chance p."""
    n = 64 * words
    return math.ceil(p * n + 4 * math.sqrt(p * (1 - p) * n))


def similar(spark: SparkSession, docs: DataFrame, share: tuple[int, int] = (4, 5), width: int = 5, seed: int = 42, recall: float = 0.999, most: int = 4_000) -> DataFrame:
    """(doc_id, row, component_id) of every row of ``docs`` (doc_id, text, others are ignored); row is xxhash64 of text.

    Rows link where the Jaccard similarity of their shingle sets is share[0] / share[1] or more; a link of just
    that similarity meets with the chance ``recall`` and is told from chance meetings with one of about 0.9998 (``_limit``);
    closer ones are found with a higher one, equal sets always, and no link is wrong. component_id is the smallest doc_id that links reach, null where there is none. Texts without a
    word are equal to each other. An empty table gives an empty result.

    The spanning forests of candidates at each anchor join texts to clusters, outside of which there are no
    candidates; within a cluster pairs are confirmed by their sets where these lie together.
    """
    work = Workspace(spark, "similar")
    blocks = layout(docs.select("doc_id").count(), share[0] / share[1], recall)
    n_words = max(2, blocks[-1][0] + 1)
    p = chance(share[0] / share[1])
    marked = work.table(_marks(docs, n_words, width, seed), "marked")
    different = marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("row").alias("row"), F.first("size").alias("size"), F.first("words").alias("words"))
    different = work.table(different.withColumn("w1", F.get("words", F.lit(1))), "different")
    found = work.table(_pairs(work, "near", different.where("size > 0"), blocks, _limit(p, 2), ("w1",), only_homes=True), "forest")
    clusters = connected_components(work, found, "clusters").withColumnRenamed("label", "cluster")
    live = work.table(different.select("node", "row", "words").join(clusters, "node"), "live")
    members = work.table(live.select("cluster", "node", "words").join(_sets(docs, live.select("node", "row"), width, seed), "node"), "members")
    links = work.table(_linked(work, members, share, _limit(p, n_words), most), "links")
    labels = connected_components(work, links, "cc")
    work.drop("forest", "live", "members")
    joined = different.select("node", "first_id").join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    smallest = joined.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = work.table(joined.join(smallest, "label").select("node", "component_id"), "classes")
    return marked.select("doc_id", "row", "node").join(classes, "node").select("doc_id", "row", "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents with one of each near-duplicate group (five-word shingles, similarity of 0.8 or more): the one of smallest doc_id.

    Rows with null doc_id stay. Columns and other rows are as they came. Rows are told apart by doc_id and text, so
    of rows of one doc_id those go whose own text has a smaller doc_id in its group; equal rows share their fate.
    """
    gone = similar(spark, docs).where("component_id < doc_id").select(F.col("doc_id").alias("gone_id"), "row").distinct()
    gone = Workspace(spark, "keep-one").table(gone, "gone")
    own = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("row"))
    own = _sifted(own, _sieve(gone))
    checked = own.where("passes").join(gone.withColumnRenamed("row", "gone_row"), (F.col("id") == F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left_anti")
    return own.where("not passes").unionAll(checked).select("own.*")


def op3_simhash_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: four-word shingles, XXH64 of seed 42, links at 4 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(spark, docs, width=4, seed=42)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
