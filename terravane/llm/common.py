"""Shared folder, tables written to cut lineage, and small helpers of the llm operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master is
    local, as in tests, a temporary folder of this process is named; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="terravane-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Tables of one operator call, below the shared folder.

    A table is written once and read from then on, so a lost executor costs the tasks that it ran and
    never the rounds before. ``drop`` removes a table that nothing reads any more; what is left goes
    when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/terravane/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.path)

    def table(self, df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.path}/{name}")

    def _remove(self, path: str) -> None:
        try:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM may have ended first
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict = {}


def held(key, make):
    """What a worker process keeps between tasks, of one operator at a time: another's makes room."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Free memory of this worker process goes back to the machine; allocators keep it otherwise."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def no_cycles():
    """Without the collector of reference cycles, where very many objects are made and none of them form cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(batches, rows: int = 1000):
    """Record batches of so many rows at most, without copies."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def compact(df: DataFrame) -> DataFrame:
    """Digests of texts, a few bytes a row, dealt out anew: few files of many rows instead of one for every task that read texts."""
    return df.repartition(F.col("doc_id"))


def crc32_of(column) -> F.Column:
    """Unsigned CRC-32 of a value's text."""
    return F.crc32(column.cast("string").cast("binary"))


def connected_components(work: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) of every node of the undirected ``edges`` (u, v longs); label: the component's smallest node.

    Each round hooks every vertex to its smallest neighbour if that is smaller, collapses the trees by
    pointer jumping, and contracts the edges to the roots, until no edge is left. All of it is joins and
    grouped minima over written tables; only row counts come to the driver. A hot vertex is combined
    before the shuffle and, in the joins, meets a side that is unique in the key.
    Empty edges give an empty result. Self loops give a node of its own.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = work.table(both.groupBy(F.col("u").alias("node")).agg(F.first("u").alias("label")), f"{name}-labels0")
    live = work.table(both.where("u <> v").distinct(), f"{name}-edges0")
    turn = 0
    while live.head(1):
        turn += 1
        parent = live.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p"))
        parent = work.table(parent, f"{name}-p{turn}-0")
        jump = 0
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            nxt = parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved"))
            jump += 1
            nxt = work.table(nxt, f"{name}-p{turn}-{jump}")
            work.drop(f"{name}-p{turn}-{jump - 1}")
            parent = nxt.select("u", "p")
            if not nxt.where("moved").head(1):
                break
        to = parent.select(F.col("u").alias("label"), F.col("p"))
        labels = work.table(labels.join(to, "label", "left").select("node", F.coalesce("p", "label").alias("label")), f"{name}-labels{turn}")
        a = parent.select("u", F.col("p").alias("pu"))
        b = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live = work.table(live.join(a, "u").join(b, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), f"{name}-edges{turn}")
        work.drop(f"{name}-labels{turn - 1}", f"{name}-edges{turn - 1}", f"{name}-p{turn}-{jump}")
    return labels
