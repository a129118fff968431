"""Wide to long and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sides(games: DataFrame, one: dict[str, str], other: dict[str, str], names: tuple[str, str], keep: list[str]) -> DataFrame:
    """Each row as two, one for each side; the dicts map output names to that side's columns. One pass, no union."""
    rows = [F.struct(F.lit(n).alias("side"), *[F.col(c).alias(o) for o, c in m.items()]) for n, m in zip(names, (one, other), strict=True)]
    return games.select(*keep, F.explode(F.array(*rows)).alias("s")).select(*keep, "s.*")


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def auto_diffs(df: DataFrame, suffixes: tuple[str, str] = ("_home", "_away"), skip: tuple[str, ...] = ()) -> DataFrame:
    """Add x_diff for every numeric pair of columns x_home, x_away, in order of names, but those that hold a word of ``skip``."""
    kinds = dict(df.dtypes)
    numeric = ("int", "bigint", "double", "float", "smallint", "decimal")
    names = sorted(
        c[: -len(suffixes[0])] for c in df.columns if c.endswith(suffixes[0]) and c[: -len(suffixes[0])] + suffixes[1] in kinds
    )
    good = [n for n in names if kinds[n + suffixes[0]].startswith(numeric) and not any(s in n for s in skip)]
    return df.withColumns({f"{n}_diff": F.col(n + suffixes[0]) - F.col(n + suffixes[1]) for n in good}) if good else df


def explode_segments(df: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """One row for each segment a row belongs to; segments may overlap."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in segments.items()]), lambda s: s.isNotNull())
    return df.withColumn("segment", F.explode(names))


def complete_grid(df: DataFrame, keys: DataFrame, periods: DataFrame, on: list[str], fill: dict[str, float], most_periods: int = 10_000) -> DataFrame:
    """Every key in every period, with ``fill`` where there is no row; more than ``most_periods`` periods are an error.

    The periods travel as one list, which each key's row unfolds.
    """
    if periods.limit(most_periods + 1).count() > most_periods:
        raise ValueError(f"more than {most_periods} periods")
    listed = periods.agg(F.collect_list(F.struct(*periods.columns)).alias("_periods"))
    grid = keys.crossJoin(F.broadcast(listed)).select(*keys.columns, F.explode("_periods").alias("_p")).select(*keys.columns, "_p.*")
    return grid.join(df, on, "left").fillna(fill)
