"""Event-time operators on streams. Each also runs on a bounded folder, by a trigger that takes what is there and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed(events: DataFrame, at: str, size: str, slide: str | None, late: str, keys: list[str], aggregates: list) -> DataFrame:
    """Aggregates per tumbling (or sliding) window; rows later than ``late`` are dropped by the watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(events: DataFrame, at: str, gap: str, late: str, keys: list[str], aggregates: list) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def distinct_within(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key seen; state older than the watermark is forgotten."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def interval_match(left: DataFrame, right: DataFrame, key: str, at: str, event: str, late: str, within: str) -> DataFrame:
    """Left rows with the right rows of their key up to ``within`` before them; both sides' state is bounded by watermarks."""
    a = left.withWatermark(at, late).alias("a")
    b = right.withWatermark(event, late).alias("b")
    span = F.expr(f"INTERVAL {within}")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{event}") <= F.col(f"a.{at}")) & (F.col(f"b.{event}") >= F.col(f"a.{at}") - span)
    return a.join(b, on)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take what is there and end; the folder holds each row once, whatever failed on the way."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Hand each micro-batch to ``handle``; it must bear being given the same batch again."""
    stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
