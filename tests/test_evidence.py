"""Majorities and context against plain recomputations."""

from collections import Counter

from terravane.operators import evidence


def test_majority(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", None), ("d", 3), ("d", 3), (None, 4), (None, 4)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r["k"]: (r["v"], r["n"], r["total"]) for r in evidence.majority(df, ["k"], "v").collect()}
    want = {}
    for k in {k for k, _ in rows}:
        own = Counter(v for q, v in rows if q == k and v is not None)
        v, n = own.most_common(1)[0]
        if own.total() >= 2 and 3 * n >= 2 * own.total():
            want[k] = (v, n, own.total())
    assert got == want
    assert evidence.majority(df.limit(0), ["k"], "v").count() == 0


def test_virtual_by_context(spark):
    rows = [(1, "Home", "TX", True)] * 3 + [(1, "Home", "TX", None), (1, "Home", "OH", False), (2, "Home", "OH", False), (2, "Home", "ME", False), (1, None, "TX", False), (1, "Home", None, False)]
    df = spark.createDataFrame(rows, "t long, name string, state string, virtual boolean")
    told = evidence.virtual_by_context(df, "t", "name", "state", "virtual", least=3)
    assert told.count() == len(rows)
    assert [tuple(r)[:3] for r in told.where("by_context").collect()] == [(1, "Home", "TX")]
    assert evidence.virtual_by_context(df, "t", "name", "state", "virtual", least=4).where("by_context").count() == 0
