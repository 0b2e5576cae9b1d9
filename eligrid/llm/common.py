"""Shared helpers: written tables in the cluster's shared folder, files on it, connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligrid.session import checkpoint

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session may go without that setting (tests); it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These settings for a while; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Shuffle files of a query built under this setting go when it ends; else they stay until the driver happens to
# collect its garbage, and many short queries fill the disk.
FREES_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def stored(df: DataFrame, purpose: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, lost executors lose nothing.

    batch_rows bounds the rows of one Arrow batch while it is written, so that whole texts stay few in a task.
    """
    spark = df.sparkSession
    path, batch = scratch(spark, purpose), {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)} if batch_rows else {}
    with settings(spark, FREES_SHUFFLES | batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_files(folder: str):
    """(file system, path) of a shared folder for code inside tasks; any scheme that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def lower_ascii(text):
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of the table has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def worker_cache(key, make):
    """A value kept while tasks of one kind reuse the Python worker; the next kind of task takes its place."""
    kept = sys.__dict__.setdefault("_eligrid_llm_cache", {})
    if key not in kept:
        free_cache()
        kept[key] = make()
    return kept[key]


def free_cache():
    """Called by tasks that keep nothing, so that they do not run beside what an earlier kind of task left behind."""
    import ctypes
    import gc

    import pyarrow as pa

    kept = sys.__dict__.get("_eligrid_llm_cache", {})
    if kept:
        kept.clear()
        gc.collect()
    # Arrow and the C library keep freed memory for themselves otherwise.
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps: every edge is replaced by one to the smallest neighbour until each
    component is a star around its smallest node. Minima are pre-aggregated before the shuffle, so a node with very
    many edges costs no more than others; each round is cut by a checkpoint. Null nodes have no edges.
    """
    spark = edges.sparkSession

    def state(df):
        # Order-free digest of the edge set; sums may wrap, which is harmless for a comparison.
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).collect()[0]
        return row["n"], row["h"]

    def arrows(df, *ends):
        """Several edges (u, v) out of each row; a union would read the table once for each."""
        return df.select(F.explode(F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ends))).alias("e")).select("e.*")

    with settings(spark, FREES_SHUFFLES):
        ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
        # From the larger node to the smaller one, as every round leaves them.
        now = checkpoint(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        before = state(now)
        while before[0]:
            low = arrows(now, ("u", "v"), ("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = now.toDF("above", "u").join(low, "u").select(F.col("above").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = arrows(large.join(least, "u"), ("v", "m"), ("u", "m")).filter("u <> v").distinct()
            now = checkpoint(small)
            after = state(now)
            if after == before:
                break
            before = after
    heads = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads)
