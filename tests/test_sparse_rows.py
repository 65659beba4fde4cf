"""Tables so large that bounds of ranges come from a sample of them."""

from pyspark.sql import functions as F

from terravane.sources import sinks


def test_sparse_rows_of_many_keys(spark):
    n = 200_000
    pairs = spark.range(n).select(F.col("id").alias("key"), (n - 1 - F.col("id")).alias("item"))
    codes, rows = sinks.sparse_rows(pairs, "key", "item")
    assert codes.count() == n and codes.where("code <> item").count() == 0
    assert rows.count() == n and rows.where("at <> key or n <> 1 or codes[0] <> 199999 - key").count() == 0
