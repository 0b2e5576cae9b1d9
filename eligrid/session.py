"""Session helpers: settings the library relies on, checked broadcasts, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes (as JSON, which is wider than Spark's rows) above which a dimension is no longer broadcast.
BROADCAST_BYTES = 256 << 20


def build_session(app: str = "eligrid", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def measured_bytes(df: DataFrame) -> int:
    """Size of a table by the width of all its rows, not by their number."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).collect()[0][0] or 0


def within_limit(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES, written: bool = False) -> DataFrame:
    """Broadcast a dimension after measuring it; otherwise leave the join to AQE.

    The dimension is computed once: it is checkpointed, unless it already is a written
    table, and both the measurement and the join read that.
    """
    kept = df if written else checkpoint(df)
    return F.broadcast(kept) if within_limit(kept, limit) else kept


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, purpose: str) -> DataFrame:
    """Like `checkpoint`, as a compressed file table in the same folder, whose files tasks can also read by themselves."""
    path = f"{checkpoint_folder(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_file(uri: str):
    """An open file of the shared folder, for code inside tasks; any scheme that Arrow knows."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of this session; only a local session without one (tests) gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()
