"""Structured Streaming jobs: feed updates, request rates, alert suppression, sessions.

Each has a batch twin in this module or among the operators, so results can be
compared. Watermarks are an addition here; the processed feeds carry none.
"""

from __future__ import annotations

import json
import sys
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import IntegerType, StructField, StructType

from eligrid.operators import relationships
from eligrid.session import checkpoint
from eligrid.sources.rules import scratch

# Executors need not have this package installed to run the stateful processors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUPPRESS_SECONDS = 10
RATE_SECONDS, RATE_SLIDE, RATE_LIMIT = 60, 10, 30
SESSION_TTL_MS = 72 * 3600 * 1000
# Lateness of a table whose files come in any order: wider than the table.
ANY_ORDER = "4000 days"
# Time of the row that closes a held stream, later than any alert and lateness.
CLOSING_US = 1 << 62


def file_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 64) -> DataFrame:
    """A parquet table as a stream; the schema comes from the files themselves."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern serves a table folder and a single file alike.
    pattern = f"{folder}/{table}.parque[t]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def late_rows(progress: list) -> int:
    """Rows that watermarks dropped, over all progress reports of a query."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


class _Dropped(StreamingQueryListener):
    """Rows that watermarks dropped in every batch; `recentProgress` keeps the last hundred batches only."""

    def __init__(self) -> None:
        self._runs: dict[str, dict[int, int]] = {}
        self._ended: set[str] = set()
        self._told = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._told:
            batches = self._runs.setdefault(str(event.progress.runId), {})
            batches[event.progress.batchId] = late_rows([json.loads(event.progress.json)])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._told:
            self._ended.add(str(event.runId))
            self._told.notify_all()

    def total(self, run_id: str, written: set[int]) -> int:
        """Dropped rows of an ended run; the reports come on another thread and must cover all batches written."""
        with self._told:
            self._told.wait_for(lambda: run_id in self._ended, timeout=120)
            batches = self._runs.get(run_id, {})
            if missing := written - set(batches):
                raise RuntimeError(f"no progress report of {len(missing)} batches, so their late rows are unknown")
            return sum(batches.values())


@dataclass
class Held:
    """A stream that holds its rows until a watermark passes them.

    `step` turns a released micro-batch into output; a row at CLOSING_US in the folder
    `closing`, a second source of the stream, releases what is still held.
    """

    rows: DataFrame
    closing: str
    step: Callable[[DataFrame, int], DataFrame]
    schema: StructType


def run_available(stream: DataFrame | Held, name: str, mode: str = "append", lose_late: bool = False) -> DataFrame:
    """Run a stream over what is there now, then read its output back.

    A held stream is closed at the end, so that it keeps nothing back. Rows lost to a
    watermark stop the job unless `lose_late` says that they may go.
    """
    held = stream if isinstance(stream, Held) else None
    rows = held.rows if held else stream
    spark = rows.sparkSession
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-state")
    schema = stream.schema
    written: set[int] = set()

    def write(batch: DataFrame, batch_id: int) -> None:
        written.add(batch_id)
        if held:
            batch = held.step(batch, batch_id)
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b{batch_id}")

    def run() -> None:
        written.clear()
        dropped = _Dropped()
        spark.streams.addListener(dropped)
        try:
            query = (
                rows.writeStream.outputMode(mode)
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .foreachBatch(write)
                .start()
            )
            try:
                query.awaitTermination()
                lost = 0 if lose_late else dropped.total(str(query.runId), written)
                if lost:
                    raise ValueError(f"{lost} rows came later than the watermark of {name} allows")
            finally:
                query.stop()
        finally:
            spark.streams.removeListener(dropped)

    run()
    if held:
        spark.range(1).select(F.lit(CLOSING_US).alias("us")).write.mode("append").parquet(held.closing)
        run()
    full = StructType([*schema.fields, StructField("batch_id", IntegerType())])
    return spark.read.schema(full).option("recursiveFileLookup", "true").parquet(out)


# ---- feed updates -----------------------------------------------------------


def feed_updates(entries: DataFrame, schemes: DataFrame, delay: str) -> DataFrame:
    """Entries that mention a scheme, each (entry, scheme) once within the watermark.

    The delay has no default: it must cover the disorder of the source, or late entries go.
    """
    text = entries.withColumn("text", F.concat_ws("\n", "title", "summary"))
    hits = relationships.mentions(text, schemes.select("scheme_id"), "text", "scheme_id")
    return hits.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["gazette_ref", "scheme_id"])


# ---- request rate -----------------------------------------------------------


def rate_windows(events: DataFrame, limit: int = RATE_LIMIT, lateness: str = "2 minutes") -> DataFrame:
    """Clients above the limit in a sliding window; combines map-side, so hot clients fold early.

    `lateness` must cover the disorder of the source: minutes for an ordered queue, the
    whole span for files read in any order. Later rows are dropped and counted by Spark
    (`late_rows`).
    """
    counted = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{RATE_SECONDS} seconds", f"{RATE_SLIDE} seconds"), "user_id")
        .agg(F.count("*").alias("n"))
    )
    return counted.where(F.col("n") > limit).select("user_id", F.col("window.start").alias("window_start"), "n")


def rate_exact(events: DataFrame, limit: int = RATE_LIMIT) -> DataFrame:
    """Per event: requests of its client in the last sixty seconds, the event included.

    An event also visits the next minute as history, so the frame never needs to look
    outside a (client, minute) partition and a hot client spreads over its minutes.
    """
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    minute = F.floor(second / (RATE_SECONDS * 1_000_000))
    spread = events.select("user_id", "event_id", second.alias("us"), minute.alias("own")).withColumn(
        "minute", F.explode(F.array("own", F.col("own") + 1))
    )
    w = Window.partitionBy("user_id", "minute").orderBy("us").rangeBetween(-RATE_SECONDS * 1_000_000 + 1, 0)
    counted = spread.withColumn("n", F.count("*").over(w))
    return counted.where((F.col("minute") == F.col("own")) & (F.col("n") > limit)).select("user_id", "event_id", "n")


# ---- alert suppression ------------------------------------------------------


def suppressed_alerts(alerts: DataFrame, lateness: str = ANY_ORDER) -> Held:
    """Alerts that are sent: a type stays silent for ten seconds after the last one sent.

    Alerts are held in state by type and time, so a hot type is spread over its times,
    until the watermark passes them. Each released batch is then later than all before
    it, and the batch twin continues from the last alert sent of every type. `lateness`
    must cover the disorder of the source: later alerts are dropped and counted by Spark
    (`late_rows`), and stop `run_available`. An alert without type or time is never sent.
    """
    spark = alerts.sparkSession
    closing, last = scratch(spark, "alerts-closing"), scratch(spark, "alerts-last")
    spark.createDataFrame([], "us long").write.parquet(closing)
    slim = alerts.where("event_type IS NOT NULL AND ts IS NOT NULL").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    end = spark.readStream.schema("us long").parquet(closing).select(
        *(F.lit(None).cast(slim.schema[c].dataType).alias(c) for c in ("event_type", "event_id")), F.timestamp_micros("us").alias("ts")
    )
    rows = slim.unionByName(end).withWatermark("ts", lateness).groupBy("event_type", "ts").agg(F.min("event_id").alias("event_id"))
    rows = rows.select("event_type", F.unix_micros("ts").alias("us"), "event_id")

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        # Written once, then read by the caller's session: a micro-batch plans without AQE.
        batch.write.mode("overwrite").parquet(f"{last}/released{batch_id}")
        table = spark.read.schema(batch.schema)
        released = table.parquet(f"{last}/released{batch_id}")
        before = table.parquet(f"{last}/sent{batch_id - 1}") if batch_id else released.limit(0)
        if released.isEmpty():
            before.write.mode("overwrite").parquet(f"{last}/sent{batch_id}")
            return released.select("event_type", "event_id")
        # The last alert sent is earlier than all released, so it starts its type's chain.
        sent = checkpoint(_sent(before.union(released)))
        sent.groupBy("event_type").agg(F.max("us").alias("us"), F.max_by("event_id", "us").alias("event_id")).write.mode("overwrite").parquet(f"{last}/sent{batch_id}")
        return sent.join(before, ["event_type", "us"], "left_anti").select("event_type", "event_id")

    return Held(rows, closing, step, slim.select("event_type", "event_id").schema)


def suppressed_alerts_batch(alerts: DataFrame) -> DataFrame:
    """Batch twin, over rows of any order."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _sent(alerts.select("event_type", us.alias("us"), "event_id")).select("event_type", "event_id")


def _sent(alerts: DataFrame) -> DataFrame:
    """The sent ones of alerts (event_type, us, event_id).

    An alert after ten silent seconds is always sent, which cuts a type into bursts.
    Inside a burst every alert points to the first one ten seconds later; the sent ones
    are those reached from the burst's start, found by doubling the pointers, so a burst
    of any length is neither one row nor one task. Previous and next alerts are found
    inside hour buckets, with the nearest alert of other buckets joined in.
    """
    gap = SUPPRESS_SECONDS * 1_000_000
    hour = 3_600_000_000
    rows = checkpoint(alerts.groupBy("event_type", "us").agg(F.min("event_id").alias("event_id")))
    marks = rows.select("event_type", "us", F.lit(1).alias("alert")).unionByName(
        rows.select("event_type", (F.col("us") + gap).alias("us"), F.lit(0).alias("alert"))
    ).withColumn("bucket", F.floor(F.col("us") / hour))
    own = F.when(F.col("alert") == 1, F.col("us"))
    # A row per type and hour: the nearest alerts of other hours.
    hours = marks.groupBy("event_type", "bucket").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    by_hour = Window.partitionBy("event_type").orderBy("bucket")
    hours = hours.select(
        "event_type", "bucket",
        F.max("last").over(by_hour.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.min("first").over(by_hour.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    # Both frames grow with the row, so an hour full of alerts costs linear time.
    inside = Window.partitionBy("event_type", "bucket").orderBy("us", "alert")
    back = Window.partitionBy("event_type", "bucket").orderBy(F.desc("us"), F.desc("alert"))
    near = marks.select(
        "event_type", "bucket", "us", "alert",
        F.max(own).over(inside.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
        F.min(own).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("next"),
    ).join(hours, ["event_type", "bucket"])
    starts = near.where("alert = 1").where(
        F.coalesce(F.col("us") - F.coalesce("prev", "before") >= gap, F.lit(True))
    ).select("event_type", "us")
    jump = near.where("alert = 0").select("event_type", (F.col("us") - gap).alias("us"), F.coalesce("next", "after").alias("to")).where("to IS NOT NULL")
    jump = jump.join(starts.select("event_type", F.col("us").alias("to")), ["event_type", "to"], "left_anti").select("event_type", "us", "to").distinct()
    rounds = []
    jump = checkpoint(jump)
    while not jump.isEmpty():
        rounds.append(jump)
        further = jump.select("event_type", F.col("us").alias("to"), F.col("to").alias("beyond"))
        jump = checkpoint(jump.join(further, ["event_type", "to"]).select("event_type", "us", F.col("beyond").alias("to")))
    sent = starts
    for step in reversed(rounds):
        sent = checkpoint(sent.union(sent.join(step, ["event_type", "us"]).select("event_type", "to")))
    return rows.join(sent, ["event_type", "us"], "left_semi").select("event_type", "us", "event_id")


# ---- session fold -----------------------------------------------------------


class _SessionFold(StatefulProcessor):
    """Current value per field of a conversation, forgotten after the time to live."""

    def __init__(self, ttl_ms: int | None) -> None:
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._fields = handle.getMapState("fields", "field string", "seq long, value string", ttlDurationMs=self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A batch holds few rows per conversation; the newest per field is all that stays.
        newest = pd.concat(list(rows)).sort_values("seq").groupby("field", as_index=False).last()
        out = []
        for field, seq, value in zip(newest["field"], newest["seq"], newest["value"]):
            known = self._fields.getValue((field,)) if self._fields.containsKey((field,)) else None
            if known is not None and known[0] > seq:
                continue
            self._fields.updateValue((field,), (int(seq), value))
            out.append((key[0], field, int(seq), value, "set" if known is None else "update"))
        yield pd.DataFrame(out, columns=["conv_id", "field", "seq", "value", "change_type"])

    def close(self) -> None:
        pass


def session_changes(extractions: DataFrame, ttl_ms: int | None = SESSION_TTL_MS) -> DataFrame:
    """Profile changes per conversation as turns stream in.

    A time to live needs processing time, and with it a stream never counts as
    finished: pass None to run over what is available and stop.
    """
    slim = extractions.select("conv_id", "field", "seq", F.coalesce(F.col("num").cast("string"), F.col("text")).alias("value"))
    return slim.groupBy("conv_id").transformWithStateInPandas(
        _SessionFold(ttl_ms), "conv_id long, field string, seq long, value string, change_type string",
        outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
