"""Calibration layers, fitted season by season on the seasons before, and the choice among them out of sample."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.joins import carry_last
from gridspark.sources.scratch import folder, written

METHODS = ("none", "sigmoid", "isotonic")


def pool(blocks: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Blocks (lowest, highest score, sum, count) in order of score, pooled until their means rise.

    Pooling parts of a sequence first and then what is left of them gives the same blocks as pooling it at once.
    """
    out: list[list[float]] = []
    for lo, hi, s, c in blocks:
        out.append([lo, hi, s, c])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, hi, s, c = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = hi, out[-1][2] + s, out[-1][3] + c
    return out


def isotonic(counts: DataFrame, key: str, score: str = "p", slices: int = 256) -> DataFrame:
    """(key, lo, hi, s, c): the blocks of a non-decreasing fit for every key, from (key, score, s, c) with one row a score.

    Slices of the score (0 to 1) are pooled on their own, and what is left of a key together. Means of whole numbers rise at most about n^(2/3)
    times over n rows, so that is little whatever n.
    """
    schema = f"{key} int, lo double, hi double, s double, c double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("lo")
        found = pool(zip(ordered["lo"], ordered["hi"], ordered["s"], ordered["c"], strict=True))
        return pd.DataFrame([(rows[key].iloc[0], *b) for b in found], columns=[key, "lo", "hi", "s", "c"])

    cut = F.least(F.lit(slices - 1), F.greatest(F.lit(0), F.floor(F.col(score) * slices))).alias("slice")
    points = counts.select(F.col(key).cast("int"), F.col(score).alias("lo"), F.col(score).alias("hi"), F.col("s").cast("double"), F.col("c").cast("double"), cut)
    parts = points.groupBy(key, "slice").applyInPandas(run, schema)
    return parts.groupBy(key).applyInPandas(run, schema)


def apply_isotonic(rows: DataFrame, blocks: DataFrame, key: str, score: str, out: str) -> DataFrame:
    """Adds the level of the score's block, between two blocks on the line between them, outside of all the nearest one's."""
    w = Window.partitionBy(key).orderBy("lo")
    level = F.col("s") / F.col("c")
    shaped = blocks.select(
        F.col(key), "lo", "hi", level.alias("level"), F.lead("lo").over(w).alias("next_lo"), F.lead(level).over(w).alias("next"),
        F.first(level).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("least"),
    )
    least = shaped.groupBy(F.col(key).alias("_key")).agg(F.min("least").alias("_least"))
    met = carry_last(rows, shaped, [key], F.col(score).cast("double"), F.col("lo"), False, [], 1 / 64)
    p, r = F.col(f"l.{score}"), lambda c: F.col(f"r.{c}")
    between = r("level") + (r("next") - r("level")) * (p - r("hi")) / (r("next_lo") - r("hi"))
    value = F.when((p <= r("hi")) | r("next").isNull(), r("level")).otherwise(between)
    found = met.select("l.*", value.alias("_level"))
    return found.join(F.broadcast(least), F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_level", "_least")).drop("_key", "_least", "_level")


def sigmoids(counts: DataFrame, key: str, score: str = "p", ridge: float = 1.0, steps: int = 100) -> dict[int, tuple[float, float, float, float]]:
    """Of each key intercept, slope, mean and scale of a logistic fit on the standardised score, the slope drawn to 0 by ``ridge``.

    Newton's steps of all keys go together; each takes five sums a key.
    """
    n = F.sum("c")
    mean = counts.groupBy(key).agg((F.sum(F.col("c") * F.col(score)) / n).alias("mean"))
    spread = counts.join(F.broadcast(mean), key).groupBy(key, "mean").agg(F.sqrt(F.sum(F.col("c") * F.pow(F.col(score) - F.col("mean"), 2)) / n).alias("sd"))
    found = {r[key]: (0.0, 0.0, r["mean"], r["sd"] if r["sd"] > 0 else 1.0) for r in spread.collect()}
    moving = set(found)
    for _ in range(steps):
        if not moving:
            break
        now = counts.sparkSession.createDataFrame([(k, *found[k]) for k in sorted(moving)], f"{key} int, a double, b double, mean double, sd double")
        x = (F.col(score) - F.col("mean")) / F.col("sd")
        z = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("a") + F.col("b") * x))
        q = 1 / (1 + F.exp(-z))
        each = counts.join(F.broadcast(now), key).select(key, x.alias("x"), (F.col("c") * q - F.col("s")).alias("g"), (F.col("c") * F.greatest(F.lit(1e-6), q * (1 - q))).alias("w"))
        sums = each.groupBy(key).agg(
            F.sum("g").alias("g0"), F.sum(F.col("g") * F.col("x")).alias("g1"), F.sum("w").alias("h00"), F.sum(F.col("w") * F.col("x")).alias("h01"),
            F.sum(F.col("w") * F.col("x") * F.col("x")).alias("h11"),
        )
        for r in sums.collect():
            a, b, *rest = found[r[key]]
            step = np.linalg.solve([[r.h00, r.h01], [r.h01, r.h11 + ridge]], [r.g0, r.g1 + ridge * b])
            found[r[key]] = (a - float(step[0]), b - float(step[1]), *rest)
            if float(np.linalg.norm(step)) < 1e-8:
                moving.discard(r[key])
    return found


def select_calibration(
    df: DataFrame, p: str, y: str, season: str, window: int, least_games: int = 150, least_gain: float = 0.0005, slices: int = 256
) -> DataFrame:
    """One row a method (none, sigmoid, isotonic): its Brier score and log loss over all seasons it could be fitted for, and whether it is the one to use.

    A season is scored by what the ``window`` seasons before it teach, if they have ``least_games`` rows and both outcomes. The best Brier score is
    taken, but a layer only if it gains ``least_gain`` over none; without such seasons none is. Rows with nulls are left out. Rows are counted by season and score first; all
    that follows goes over those counts.
    """
    spark = df.sparkSession
    root = folder(spark, "calibration")
    whole = df.select(F.col(season).cast("int").alias("season"), F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y")).dropna()
    counts = written(whole.groupBy("season", "p").agg(F.sum("y").alias("s"), F.count(F.lit(1)).cast("double").alias("c")), f"{root}/counts")
    taught = counts.withColumn("season", F.explode(F.sequence(F.col("season") + 1, F.col("season") + window)))
    taught = taught.groupBy("season", "p").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    enough = taught.groupBy("season").agg(F.sum("c").alias("n"), F.sum("s").alias("won")).filter((F.col("n") >= least_games) & (F.col("won") > 0) & (F.col("won") < F.col("n")))
    enough = enough.join(counts.select("season").distinct(), "season", "left_semi").select("season")
    train = written(taught.join(F.broadcast(enough), "season"), f"{root}/train")
    test = counts.join(F.broadcast(enough), "season")
    fits = sigmoids(train, "season")
    lines = spark.createDataFrame([(k, *v) for k, v in fits.items()], "season int, a double, b double, mean double, sd double")
    scored = apply_isotonic(test, isotonic(train, "season", "p", slices), "season", "p", "isotonic").join(F.broadcast(lines), "season")
    sigmoid = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * (F.col("p") - F.col("mean")) / F.col("sd"))))
    each = scored.select("season", "s", "c", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("method"), q.alias("q")) for i, (m, q) in enumerate(zip(METHODS, (F.col("p"), sigmoid, F.col("isotonic")), strict=True))])))
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("q")))
    won, lost = F.col("s"), F.col("c") - F.col("s")
    scores = each.groupBy("i", "method").agg(
        F.try_divide(F.sum(won * F.pow(1 - q, 2) + lost * F.pow(q, 2)), F.sum("c")).alias("brier"), F.try_divide(F.sum(-won * F.ln(q) - lost * F.ln(1 - q)), F.sum("c")).alias("log_loss"),
        F.sum("c").cast("long").alias("n_games"), F.countDistinct("season").alias("n_seasons"),
    )
    names = spark.createDataFrame(list(enumerate(METHODS)), "i int, method string")
    told = names.join(scores.drop("i"), "method", "left").na.fill(0, ["n_games", "n_seasons"])
    every = Window.partitionBy(F.lit(1))  # three rows
    none = F.max(F.when(F.col("method") == "none", F.col("brier"))).over(every)
    best = F.min(F.when(F.col("brier").isNotNull(), F.struct("brier", "i"))).over(every)
    gained = none - F.col("best.brier") >= least_gain
    told = told.withColumns({"best": best, "plain": none})
    chosen = F.when(F.col("best").isNotNull() & gained & (F.col("best.i") > 0), F.col("best.i")).otherwise(0)
    return told.withColumn("selected", F.col("i") == chosen).select("method", "brier", "log_loss", "n_games", "n_seasons", "selected")
