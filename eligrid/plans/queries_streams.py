"""Queries of the streaming jobs, run over the tables as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid.plans import derive
from eligrid.plans import oracle_core as oc
from eligrid.plans.queries_conversation import _EXT
from eligrid.plans.queries_quality import FEED
from eligrid.plans.registry import query
from eligrid.plans.views import Views
from eligrid.streaming import streams


def _stateful(v: Views) -> None:
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)


@query(
    "stream_feed",
    oc.sql(
        """SELECT gazette_ref, scheme_id, notification_date FROM feed f JOIN schemes s
        ON contains(lower(f.title), lower(s.scheme_id)) OR contains(lower(f.summary), lower(s.scheme_id))""",
        **FEED,
    ),
)
def stream_feed(v: Views) -> DataFrame:
    _stateful(v)
    orders = streams.file_stream(v.spark, v.folder, "orders")
    # Replayed entries (each is fed twice) must come out once.
    twice = orders.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    entries = v.spark.sql(derive.FEED_SQL, orders=twice).withColumns(
        {"summary": F.coalesce("summary_raw", "title"), "ts": F.col("notification_date").cast("timestamp")}
    )
    updates = streams.feed_updates(entries, v.schemes(), "4000 days")
    return streams.run_available(updates.select("gazette_ref", "scheme_id", "notification_date"), "feed").drop("batch_id")


# The events are sparse: two requests within the window already count as a burst here.
LIMIT = 1


@query(
    "stream_rate",
    f"""SELECT user_id, make_timestamp(CAST(ws * 1000000 AS BIGINT)) AS window_start, count(*) AS n FROM (
      SELECT user_id, CAST(floor(epoch_us(ts) / 10000000) AS BIGINT) * 10 - 10 * unnest(range(6)) AS ws FROM events) GROUP BY 1, 2 HAVING count(*) > {LIMIT}""",
)
def stream_rate(v: Views) -> DataFrame:
    _stateful(v)
    events = streams.file_stream(v.spark, v.folder, "events")
    # Files come in any order, so the allowed lateness is wider than the table.
    updates = streams.run_available(streams.rate_windows(events, LIMIT, "4000 days"), "rate", "update")
    # In update mode a window may be reported again with a higher count.
    return updates.groupBy("user_id", "window_start").agg(F.max("n").alias("n")).select(
        "user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n"
    )


@query(
    "stream_rate_exact",
    f"""SELECT user_id, event_id, n FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > {LIMIT}""",
)
def stream_rate_exact(v: Views) -> DataFrame:
    return streams.rate_exact(v.table("events"), LIMIT)


_SUPPRESS = """WITH RECURSIVE a AS (SELECT event_type, epoch_us(ts) AS us, min(event_id) AS event_id FROM events GROUP BY 1, 2),
  n AS (SELECT event_type, us, min(us) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 10000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM a),
  sent AS (SELECT event_type, min(us) AS us FROM a GROUP BY 1 UNION ALL SELECT n.event_type, n.nxt FROM sent JOIN n USING (event_type, us) WHERE n.nxt IS NOT NULL)
  SELECT event_type, event_id FROM sent JOIN a USING (event_type, us)"""


@query("stream_alert_suppress_batch", _SUPPRESS)
def stream_alert_suppress_batch(v: Views) -> DataFrame:
    return streams.suppressed_alerts_batch(v.table("events"))


@query("stream_alert_suppress", _SUPPRESS)
def stream_alert_suppress(v: Views) -> DataFrame:
    _stateful(v)
    alerts = streams.file_stream(v.spark, v.folder, "events")
    # Files come in any order, so alerts are held until all are read.
    return streams.run_available(streams.suppressed_alerts(alerts, streams.ANY_ORDER), "alerts").drop("batch_id")


@query(
    "session_stream",
    f"""SELECT conv_id, field, seq, coalesce(CAST(num AS STRING), text) AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, field ORDER BY seq DESC) AS rn FROM ({_EXT})) WHERE rn = 1""",
)
def session_stream(v: Views) -> DataFrame:
    """State after the stream has run: the newest change per conversation and field."""
    _stateful(v)
    events = streams.file_stream(v.spark, v.folder, "events")
    said = v.spark.sql(derive.EXTRACTIONS_SQL.replace("{day}", derive.SPARK_DAY), events=events)
    changes = streams.run_available(streams.session_changes(said, ttl_ms=None), "session", "update")
    return changes.groupBy("conv_id", "field").agg(F.max_by(F.struct("seq", "value"), "seq").alias("c")).select(
        "conv_id", "field", "c.seq", "c.value"
    )
