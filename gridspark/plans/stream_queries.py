"""Streaming operators run over the bounded events table, so that batch SQL can state their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans.registry import query
from gridspark.sources.scratch import folder
from gridspark.streaming import events as stream

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, so that the table may be one file or a folder of files
    rows = stream.read_events(spark, f"{sf_dir}/events.parque[t]", SCHEMA)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _result(spark: SparkSession, frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    out = folder(spark, name)
    stream.run_to_table(frame, f"{out}/rows", f"{out}/state", mode)
    return spark.read.schema(frame.schema).parquet(f"{out}/rows")


@query(
    "stream_tumbling_counts",
    """SELECT to_timestamp(FLOOR(EPOCH(ts) / 3600) * 3600)::TIMESTAMP AS window_start, event_type, COUNT(*) AS n FROM events
    WHERE FLOOR(EPOCH(ts) / 3600) * 3600 + 3600 <= (SELECT FLOOR(EPOCH_MS(MAX(ts)) / 1000.0) FROM events) - 600 GROUP BY 1, 2""",
)
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark (ten minutes behind the last event) has passed."""
    out = stream.windowed(_source(spark, sf_dir), "ts", "1 hour", None, "10 minutes", ["event_type"], [F.count(F.lit(1)).alias("n")])
    return _result(spark, out, "tumbling").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "stream_sessions",
    """WITH e AS (SELECT *, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n_session FROM e),
    g AS (SELECT user_id, n_session, MIN(ts) AS session_start, MAX(ts) + INTERVAL 2 HOUR AS session_end, COUNT(*) AS n, ROUND(SUM(value), 4) AS value FROM s GROUP BY 1, 2)
    SELECT session_start, session_end, user_id, n, value FROM g WHERE session_end <= (SELECT date_trunc('milliseconds', MAX(ts)) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stream.sessions(_source(spark, sf_dir), "ts", "2 hours", "10 minutes", ["user_id"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")])
    ended = _result(spark, out, "sessions")
    naive = {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    return ended.withColumns(naive).withColumn("value", F.round("value", 4))


@query("stream_distinct", "SELECT event_type, user_id FROM events GROUP BY 1, 2")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (type, user): the watermark's delay spans the table."""
    out = stream.distinct_within(_source(spark, sf_dir), "ts", "60 days", ["event_type", "user_id"])
    return _result(spark, out, "distinct").select("event_type", "user_id")


@query(
    "stream_interval_match",
    """SELECT a.event_id, b.event_id AS seen_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view'
      AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 6 HOUR""",
)
def stream_interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _source(spark, sf_dir).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = _source(spark, sf_dir).filter("event_type = 'view'").select(F.col("event_id").alias("seen_id"), "user_id", F.col("ts").alias("seen"))
    met = stream.interval_match(a, b, "user_id", "ts", "seen", "1 hour", "6 HOURS").select("a.event_id", "b.seen_id")
    return _result(spark, met, "interval")
