"""Checks of tables: one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long(df: DataFrame, measures: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per column from one aggregation over many."""
    flat = df.agg(*[m.alias(f"{c}__{n}") for c, ms in measures.items() for n, m in ms.items()])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").cast("double").alias(n) for n in ms]) for c, ms in measures.items()]
    return flat.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def completeness(df: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    """Fill rate of each column, and whether it is enough."""
    rates = _long(df, {c: {"fill_rate": F.avg(F.col(c).isNotNull().cast("int"))} for c in columns})
    return rates.withColumn("ok", F.col("fill_rate") >= least)


def feature_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null rate, variance, least and largest value of each column."""
    return _long(df, {c: {"null_rate": F.avg(F.col(c).isNull().cast("int")), "variance": F.var_samp(c), "low": F.min(c), "high": F.max(c)} for c in columns})


def select_features(df: DataFrame, columns: list[str], least: int = 50, variance: float = 1e-9) -> list[str]:
    """Columns with enough values and spread, in their order; decided from one row of aggregates."""
    row = df.agg(*[m for c in columns for m in (F.count(c), F.var_samp(c))]).first()
    return [c for i, c in enumerate(columns) if row[2 * i] >= least and (row[2 * i + 1] or 0) > variance]


def outliers(df: DataFrame, column: str, deviations: float = 3.0) -> DataFrame:
    """Rows further than so many deviations from the mean."""
    stats = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    far = F.abs(F.col(column) - F.col("_m")) > deviations * F.col("_s")
    return df.crossJoin(F.broadcast(stats)).filter(far).drop("_m", "_s")


def freshness(df: DataFrame, date: str, now: Column, most_days: int) -> DataFrame:
    out = df.agg(F.max(date).alias("latest")).withColumn("age_days", F.datediff(now, "latest"))
    return out.withColumn("fresh", F.col("age_days") <= most_days)


def validate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Failures of each named check (true: fine; null counts as a failure)."""
    counted = {n: {"failures": F.count_if(~F.coalesce(c, F.lit(False)))} for n, c in checks.items()}
    return _long(df, counted).select(F.col("column").alias("check"), F.col("failures").cast("long").alias("failures"))
