"""Estimates that use strictly earlier periods only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import odds
from gridspark.sources.scratch import folder, written

ALL = Window.unboundedPreceding


def before(df: DataFrame, season: str, week: str, at: tuple[int, int] | None) -> DataFrame:
    """Rows of earlier seasons, or of earlier weeks of the season; all rows without a point."""
    if at is None:
        return df
    return df.filter((F.col(season) < at[0]) | ((F.col(season) == at[0]) & (F.col(week) < at[1])))


def prior_rates(df: DataFrame, keys: list[str], period: str, y: str, out: str) -> DataFrame:
    """A row per key and period with the rate of ``y`` over all earlier ones: sums per period, then a running sum of those."""
    per = df.groupBy(*keys, period).agg(F.sum(y).alias("_s"), F.count(y).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(ALL, -1)
    return per.select(*keys, period, F.try_divide(F.sum("_s").over(w), F.sum("_c").over(w)).alias(out), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias(f"{out}_n"))


def prior_rate(df: DataFrame, keys: list[str], period: str, y: str, out: str) -> DataFrame:
    """Rows with the rate of ``y`` over all earlier periods of their key."""
    return df.join(prior_rates(df, keys, period, y, out), [*keys, period], "left")


def residual_cdf(
    df: DataFrame, keys: list[str], period: str, residual: str, point: str, out: str, shrink: float = 20.0, base: float = 0.5, slices: int = 64
) -> DataFrame:
    """Share of the key's residuals of earlier periods above each row's ``point``, drawn to ``base`` with ``shrink`` rows' weight.

    Periods are numbered. A residual joins the even nodes over its number in a binary tree, a point asks the nodes that together make
    up all earlier numbers: at most one a level. In a node all are put in order of value and counted along; nodes are cut into slices of
    value, whose counts are carried over. So n different residuals make n log(periods) rows, and none is paired with another. Rows with the same
    residual and point in a period are counted first; the shares come in a table of their own, which the rows meet without a sort where it is small.
    """
    root = folder(df.sparkSession, "residuals")
    cells = df.groupBy(*keys, period, F.col(residual).cast("double").alias("_r"), F.col(point).cast("double").alias("_a")).agg(F.count(F.lit(1)).alias("_c"))
    cells = written(cells, f"{root}/cells")
    periods = cells.select(F.col(period).alias("_p")).filter("_p is not null").distinct().withColumn("_i", F.row_number().over(Window.orderBy("_p")) - 1)
    levels = max(1, int(periods.agg(F.max("_i")).first()[0] or 0).bit_length())
    span = cells.groupBy(*keys).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    placed = lambda table: table.join(periods, F.col(period) == F.col("_p")).join(span, keys)
    part = F.try_divide((F.col("_v") - F.col("_lo")) * slices, F.col("_hi") - F.col("_lo"))
    cut = F.greatest(F.lit(0), F.least(F.lit(slices - 1), F.floor(F.coalesce(part, F.lit(0.0))))).cast("int").alias("_b")
    named = [F.col(k) for k in keys]
    every = F.sequence(F.lit(0), F.lit(levels - 1))
    over = F.filter(F.transform(every, lambda l: F.struct(l.alias("l"), F.call_function("shiftright", F.col("_i"), l).alias("node"))), lambda x: x["node"] % 2 == 0)
    under = F.transform(
        F.filter(every, lambda l: F.call_function("shiftright", F.col("_i"), l) % 2 == 1),
        lambda l: F.struct(l.alias("l"), (F.call_function("shiftright", F.col("_i"), l) - 1).alias("node")),
    )
    missed = cells.filter("_r is not null").groupBy(*keys, period, F.col("_r").alias("_v")).agg(F.sum("_c").alias("_one"))
    history = placed(missed).select(*named, "_v", "_one", F.explode(over).alias("_n"), "_lo", "_hi")
    asked = placed(cells.filter("_a is not null").select(*keys, period, F.col("_a").alias("_v")).distinct())
    asking = asked.select(*named, "_v", F.lit(0).cast("long").alias("_one"), "_i", F.explode(under).alias("_n"), "_lo", "_hi")
    rows = history.unionByName(asking, allowMissingColumns=True).select(*named, "_n", "_v", "_one", "_i", cut)
    group = [*keys, "_n", "_b"]
    inside = Window.partitionBy(*group).orderBy(F.desc("_v"), "_one").rowsBetween(ALL, 0)
    above = Window.partitionBy(*keys, "_n").orderBy(F.desc("_b")).rowsBetween(ALL, -1)
    counts = rows.groupBy(*group).agg(F.sum("_one").alias("_c"))
    carried = counts.select(*group, F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_over")).repartition(*group)
    counted = rows.withColumn("_in", F.sum("_one").over(inside)).filter("_one = 0").join(carried, group)
    hits = counted.groupBy(*keys, "_i", "_v").agg(F.sum(F.col("_in") + F.col("_over")).alias("_hits"))
    hits = written(hits.join(periods, "_i").select(*named, F.col("_p").alias(period), F.col("_v").alias("_at"), "_hits"), f"{root}/hits")
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(ALL, -1)
    sizes = cells.groupBy(*keys, period).agg(F.coalesce(F.sum(F.when(F.col("_r").isNotNull(), F.col("_c"))), F.lit(0)).alias("_c"))
    sizes = written(sizes.select(*keys, period, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias(f"{out}_n")), f"{root}/sizes")
    joined = df.withColumn("_at", F.col(point).cast("double")).join(hits, [*keys, period, "_at"], "left").join(sizes, [*keys, period], "left")
    n = F.col(f"{out}_n")
    return joined.withColumn(out, (F.coalesce("_hits", F.lit(0)) + shrink * base) / (n + shrink)).select(*df.columns, out, f"{out}_n")


def blend_weight(df: DataFrame, keys: list[str], period: str, model: str, market: str, y: str, gain: float = 2.0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Weight of the model against the market from the Brier scores of earlier periods; 0.5 without any."""
    per = df.groupBy(*keys, period).agg(
        F.sum(F.pow(F.col(model) - F.col(y), 2)).alias("_a"), F.sum(F.pow(F.col(market) - F.col(y), 2)).alias("_b")
    )
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(ALL, -1)
    rel = F.try_divide(F.sum("_b").over(w) - F.sum("_a").over(w), F.sum("_b").over(w))
    weight = F.greatest(F.lit(low), F.least(F.lit(high), 0.5 + gain * F.coalesce(rel, F.lit(0.0))))
    return df.join(per.select(*keys, period, weight.alias("weight")), [*keys, period], "left").withColumn(
        "blended", F.col("weight") * F.col(model) + (1 - F.col("weight")) * F.col(market)
    )


def backoff_rate(train: DataFrame, score: DataFrame, levels: list[list[str]], y: str, least: int, out: str) -> DataFrame:
    """Rate of ``y`` in the first level of keys with at least ``least`` training rows; the last level should be empty (overall)."""
    result = score
    for i, keys in enumerate(levels):
        rates = train.groupBy(*keys).agg(F.avg(y).alias(f"_r{i}"), F.count(y).alias(f"_c{i}"))
        rates = rates.filter(F.col(f"_c{i}") >= (least if keys else 0)).drop(f"_c{i}")
        result = result.join(rates, keys, "left") if keys else result.crossJoin(F.broadcast(rates))
    picks = reduce(lambda a, i: F.coalesce(a, F.col(f"_r{i}")), range(len(levels)), F.lit(None).cast("double"))
    return result.withColumn(out, picks).drop(*[f"_r{i}" for i in range(len(levels))])


def platt(df: DataFrame, score: str, y: str, ridge: float = 1e-6, steps: int = 25) -> tuple[float, float]:
    """Intercept and slope of a logistic calibration, by Newton steps over five sums each."""
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.col(score) * b)))
        w, x = p * (1 - p), F.col(score)
        s = df.select((F.col(y) - p).alias("g"), w.alias("w"), x.alias("x")).agg(
            F.sum("g"), F.sum(F.col("g") * F.col("x")), F.sum("w"), F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.pow("x", F.lit(2)))
        ).first()
        if s[0] is None:
            return 0.0, 0.0
        g0, g1, h00, h01, h11 = s[0] - ridge * a, s[1] - ridge * b, s[2] + ridge, s[3], s[4] + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def split(df: DataFrame, season: str, score_season: int, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, score): all earlier seasons, from ``first`` on, and the season itself."""
    early = F.col(season) < score_season
    return df.filter(early if first is None else early & (F.col(season) >= first)), df.filter(F.col(season) == score_season)




def walk_forward_scores(
    games: DataFrame, features: list[str], margin: str, cadence: str = "week", first: int | None = None, least: int = 150, ridge: float = 1.0
) -> DataFrame:
    """Final games with ``pred_margin``, ``win_prob`` and what they were trained on, each chunk scored by a model of what was final before it.

    A chunk is a week, trained on earlier weeks and seasons, or (``cadence`` season) a season, trained on earlier seasons, from ``first`` on. The model is a ridge
    regression of the margin (the intercept free), the chance of winning that of a normal margin. Its sums of products are made per week, and run over the weeks:
    so each chunk's model is solved from one row, without a pass of its own over the games. A chunk with fewer than ``least`` games before it, or without a win
    or a loss among them, is not scored. Missing features count as 0.
    """
    x = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]]
    d, y = len(x), F.col(margin).cast("double")
    final = games.filter(F.col(margin).isNotNull() & F.col("season").isNotNull() & F.col("week").isNotNull())
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    taught = F.lit(True) if first is None else F.col("season") >= first
    names = {**{f"_s{i}_{j}": x[i] * x[j] for i, j in pairs}, **{f"_t{i}": x[i] * y for i in range(d)}, "_yy": y * y, "_n": F.lit(1.0), "_won": (y > 0).cast("double"), "_lost": (y < 0).cast("double")}
    weeks = final.groupBy("season", "week").agg(*[F.coalesce(F.sum(F.when(taught, v)), F.lit(0.0)).alias(n) for n, v in names.items()], F.count(F.lit(1)).alias("_games"))
    #: One row a week of the calendar.
    before = Window.orderBy("season", "week").rowsBetween(ALL, -1) if cadence == "week" else Window.orderBy("season").rangeBetween(ALL, -1)
    run = weeks.select(
        "season", "week", F.when(F.lit(cadence == "week"), F.row_number().over(Window.partitionBy("season").orderBy("week")) - 1).otherwise(0).alias("refit_id"),
        *[F.sum(n).over(before).alias(n) for n in names], F.min(F.when(F.col("_n") > 0, F.col("season"))).over(before).alias("train_start"),
        F.max(F.when(F.col("_n") > 0, F.col("season"))).over(before).alias("train_end"),
    ).filter((F.col("_n") >= least) & (F.col("_won") > 0) & (F.col("_lost") > 0))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                s = np.zeros((d, d))
                for i, j in pairs:
                    s[i, j] = s[j, i] = r[f"_s{i}_{j}"]
                t = np.array([r[f"_t{i}"] for i in range(d)])
                b = np.linalg.solve(s + ridge * np.diag([0.0] + [1.0] * (d - 1)), t) if d > 1 else t / s[0, 0]
                spread = max((r["_yy"] - 2 * b @ t + b @ s @ b) / r["_n"], 1e-9) ** 0.5
                out.append((r["season"], r["week"], r["refit_id"], int(r["train_start"]), int(r["train_end"]), int(r["_n"]), b.tolist(), spread))
            yield pd.DataFrame(out, columns=["season", "week", "refit_id", "train_start", "train_end", "train_rows", "_b", "_spread"])

    kinds = dict(run.dtypes)
    schema = f"season {kinds['season']}, week {kinds['week']}, refit_id int, train_start int, train_end int, train_rows long, _b array<double>, _spread double"
    models = run.mapInPandas(solve, schema)
    scored = final.join(F.broadcast(models), ["season", "week"])
    told = sum((F.col("_b")[i] * v for i, v in enumerate(x)), F.lit(0.0))
    return scored.withColumn("pred_margin", told).withColumn("win_prob", odds.normal_cdf(F.col("pred_margin") / F.col("_spread"))).drop("_b", "_spread")
