"""Row identity: de-duplication, priorities, incremental maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; give an order that leaves no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def priority_coalesce(df: DataFrame, keys: list[str], priority: str, values: list[str]) -> DataFrame:
    """One row per key: each value from the source of best priority that has one."""
    return df.groupBy(*keys).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(priority))).alias(v) for v in values])


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; a column that only one has is null in the other."""
    seen = old.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        hit = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = hit if same is None else same & hit
    return old.unionByName(new.join(seen, same, "left_anti"), allowMissingColumns=True)


def replace_partitions(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose ``key`` value does not occur in ``new``, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: count and a hash of the rows that depends on neither their order nor that of the columns.

    Names, types and nulls count: 1 differs from "1", and a null from any text.
    """
    kinds, mark = dict(df.dtypes), "\x1f"
    parts = [x for c in sorted(df.columns) for x in (F.lit(f"{c}:{kinds[c]}"), F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    digest = F.conv(F.substring(F.md5(F.concat_ws(mark, *parts)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).cast("string").alias("hash"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys and names of the values that differ between two snapshots, nulls being values."""
    a = old.select(*keys, F.explode(_pairs(values)).alias("p")).select(*keys, F.col("p.name").alias("name"), F.col("p.value").alias("before"))
    b = new.select(*keys, F.explode(_pairs(values)).alias("p")).select(*keys, F.col("p.name").alias("name"), F.col("p.value").alias("after"))
    return a.join(b, [*keys, "name"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def _pairs(values: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("string").alias("value")) for v in values])


def collisions(df: DataFrame, key: Column, of: str) -> DataFrame:
    """Keys that stand for more than one distinct value."""
    grouped = df.groupBy(key.alias("key")).agg(F.countDistinct(of).alias("n_values"))
    return grouped.filter((F.col("n_values") > 1) & F.col("key").isNotNull())
