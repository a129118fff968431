"""Leak-free form features: every frame ends before the current row unless its name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ALL = Window.unboundedPreceding


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def prior_mean(value: Column, w: WindowSpec, n: int | None = None) -> Column:
    """Mean of the last ``n`` rows before this one; of all, without ``n``."""
    return F.avg(value).over(w.rowsBetween(-n if n else ALL, -1))


def prior_std(value: Column, w: WindowSpec) -> Column:
    """Sample deviation of all earlier rows; null with fewer than two."""
    return F.stddev_samp(value).over(w.rowsBetween(ALL, -1))


def prior_count(value: Column, w: WindowSpec) -> Column:
    return F.count(value).over(w.rowsBetween(ALL, -1))


def lag_features(df: DataFrame, value: str, w: WindowSpec) -> DataFrame:
    """Add the last value, its change against the one before, and the relative change (null at a base of 0)."""
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return df.withColumns(
        {f"{value}_prev": one, f"{value}_delta": one - two, f"{value}_pct": F.try_divide(one - two, F.abs(two))}
    )


def run_length(df: DataFrame, flag: Column, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Length of the run of true flags that ends at each row, the row included; 0 where the flag is not true."""
    on = F.coalesce(flag, F.lit(False))
    w = ordered(keys, order)
    island = F.sum(F.when(on, 0).otherwise(1)).over(w.rowsBetween(ALL, 0))
    marked = df.withColumn("_on", on).withColumn("_island", island)
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(ALL, 0)
    return marked.withColumn(out, F.when(F.col("_on"), F.sum(F.col("_on").cast("int")).over(inside)).otherwise(0)).drop("_on", "_island")


def since_flag(df: DataFrame, flag: Column, at: str, keys: list[str], out: str) -> DataFrame:
    """Difference of ``at`` to its last earlier value with a true flag; null before the first."""
    last = F.last(F.when(flag, F.col(at)), ignorenulls=True).over(ordered(keys, [at]).rowsBetween(ALL, -1))
    return df.withColumn(out, F.col(at) - last)


def carry_forward(value: Column, w: WindowSpec) -> Column:
    """The last value that is not null, the current row included."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(ALL, 0))


def ewm(df: DataFrame, value: str, keys: list[str], order: list[str], span: int, out: str, prior: bool = True) -> DataFrame:
    """Exponentially weighted mean of earlier rows, with ``prior`` False of the row itself too.

    The first value starts it. A row without a value keeps the mean, but ages it: after a gap the next value weighs the more. A mean and
    a new value meet as ((1 - alpha)^gap mean + alpha value) over the sum of both weights, so each value takes over a share that depends
    on the gap before it alone. The fold goes over the last values that still carry weight: what lies further back counts for less
    than 2**-60 of the mean, so no row holds its whole history.
    """
    alpha = 2 / (span + 1)
    reach = math.ceil(60 * math.log(2) / -math.log(1 - alpha)) if span > 1 else 1
    there = F.col(value).isNotNull()
    numbered = df.withColumn("_at", F.row_number().over(ordered(keys, order))).withColumn("_there", there)
    own = Window.partitionBy(*keys, "_there").orderBy("_at")
    aged = F.pow(F.lit(1 - alpha), F.col("_at") - F.lag("_at").over(own))
    marked = numbered.withColumn("_old", aged).withColumn("_one", F.struct(F.col(value).cast("double").alias("x"), F.col("_old").alias("w")))
    folded = F.aggregate(
        F.collect_list("_one").over(own.rowsBetween(-reach, 0)), F.lit(None).cast("double"),
        lambda acc, r: F.when(acc.isNull(), r["x"]).otherwise((r["w"] * acc + alpha * r["x"]) / (r["w"] + alpha)),
    )
    last = F.last("_ewm_row", ignorenulls=True).over(ordered(keys, ["_at"]).rowsBetween(ALL, -1 if prior else 0))
    return marked.withColumn("_ewm_row", F.when(F.col("_there"), folded)).withColumn(out, last).drop("_at", "_there", "_old", "_one", "_ewm_row")


def ewm_prior(df: DataFrame, value: str, keys: list[str], order: list[str], span: int, out: str) -> DataFrame:
    return ewm(df, value, keys, order, span, out)


def rows_since(df: DataFrame, flag: Column, keys: list[str], order: list[str], cap: int, out: str) -> DataFrame:
    """Rows between each row and the last earlier one with a true flag (0: the row before), ``cap`` at most and before any."""
    w = ordered(keys, order)
    numbered = df.withColumn("_at", F.row_number().over(w))
    last = F.last(F.when(flag, F.col("_at")), ignorenulls=True).over(w.rowsBetween(ALL, -1))
    return numbered.withColumn(out, F.least(F.lit(cap), F.coalesce(F.col("_at") - 1 - last, F.lit(cap)))).drop("_at")


def drawdown(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Add the running peak and the relative fall below it."""
    peak = F.max(value).over(ordered(keys, order).rowsBetween(ALL, 0))
    return df.withColumn("peak", peak).withColumn("drawdown", F.try_divide(F.col("peak") - F.col(value), F.col("peak")))


def compound(df: DataFrame, growth: Column, keys: list[str], order: list[str], start: float, out: str) -> DataFrame:
    """Bankroll after each row where every stake is a share of it: start × the product of (1 + growth)."""
    total = F.sum(F.log(1 + growth)).over(ordered(keys, order).rowsBetween(ALL, 0))
    return df.withColumn(out, start * F.exp(total))


def first_last_flags(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    up, down = w.orderBy(*order), w.orderBy(*[F.desc(c) for c in order])
    return df.withColumn("is_first", F.row_number().over(up) == 1).withColumn("is_last", F.row_number().over(down) == 1)
