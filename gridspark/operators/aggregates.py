"""Evaluation aggregates: sweeps, scopes, bins, decompositions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import odds


def bet_record(profit: Column) -> list[Column]:
    """Bets, wins, losses, pushes, hit rate over decided bets, and return on one unit a bet."""
    won, lost = F.count_if(profit > 0), F.count_if(profit < 0)
    return [
        F.count(profit).alias("bets"), won.alias("wins"), lost.alias("losses"), F.count_if(profit == 0).alias("pushes"),
        F.try_divide(won, won + lost).alias("hit_rate"), F.try_divide(F.sum(profit), F.count(profit)).alias("roi"),
    ]


def threshold_sweep(df: DataFrame, metric: str, thresholds: list[float], aggregates: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Aggregates of the rows above each threshold; a threshold without rows keeps its row.

    Each row is counted once for each threshold it passes by exploding the list of those, so nothing is paired.
    """
    spark = df.sparkSession
    steps = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(metric) > t)
    summed = df.withColumn("threshold", F.explode(passed)).groupBy(*(keys or []), "threshold").agg(*aggregates)
    frame = df.select(*keys).distinct().crossJoin(F.broadcast(steps)) if keys else steps
    return frame.join(summed, [*(keys or []), "threshold"], "left")


def scope_rollup(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Aggregates over several sets of columns in one pass; a column outside a row's set reads "all"."""
    names = sorted({c for s in sets for c in s})
    keys = [F.col(c) for c in names]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*aggregates, *[F.grouping(c).alias(f"_g_{c}") for c in names])
    shown = {c: F.when(F.col(f"_g_{c}") == 1, "all").otherwise(F.col(c).cast("string")) for c in names}
    return grouped.withColumns(shown).drop(*[f"_g_{c}" for c in names])


def calibration(df: DataFrame, bin_: Column, p: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Count, mean prediction, rate and their gap for each bin."""
    out = df.withColumn("bin", bin_).filter(F.col("bin").isNotNull()).groupBy(*(keys or []), "bin")
    out = out.agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def brier_parts(df: DataFrame, bin_: Column, p: str, y: str) -> DataFrame:
    """One row: reliability, resolution and uncertainty over bins."""
    bins = df.withColumn("bin", bin_).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"), F.sum(y).alias("sy"))
    total = bins.agg(F.sum("n").alias("all"), (F.sum("sy") / F.sum("n")).alias("base"))
    joined = bins.crossJoin(F.broadcast(total))
    return joined.agg(
        (F.sum(F.col("n") * F.pow(F.col("mp") - F.col("my"), 2)) / F.max("all")).alias("reliability"),
        (F.sum(F.col("n") * F.pow(F.col("my") - F.col("base"), 2)) / F.max("all")).alias("resolution"),
        (F.max("base") * (1 - F.max("base"))).alias("uncertainty"),
    )


def confusion(df: DataFrame, predicted: Column, actual: Column, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and what is derived from them; a ratio without a base is 0."""
    counts = df.groupBy(*(keys or [])).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & ~actual).alias("tn"), F.count_if(~predicted & actual).alias("fn"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "specificity": rate(tn, tn + fp), "accuracy": rate(tp + tn, tp + fp + tn + fn), "f1": rate(2 * tp, 2 * tp + fp + fn)}
    )


def auc(df: DataFrame, p: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties at half.

    Scores are first counted by value, so the ordered pass holds distinct scores and not rows.
    """
    keys = keys or []
    values = df.groupBy(*keys, p).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("n") - F.col("pos")
    placed = values.withColumn("below", F.coalesce(F.sum(neg).over(below), F.lit(0)))
    summed = placed.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + neg / 2)).alias("u"), F.sum("pos").alias("p1"), F.sum(neg).alias("p0"))
    return summed.select(*keys, F.try_divide("u", F.col("p1") * F.col("p0")).alias("auc"))


def season_stability(df: DataFrame, profit: str, season: str, keys: list[str], least: int) -> DataFrame:
    """Over seasons with at least ``least`` bets: how many, how many in profit, and mean, least and spread of their returns."""
    per = df.groupBy(*keys, season).agg(F.count(profit).alias("n"), F.avg(profit).alias("roi")).filter(F.col("n") >= least)
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seasons"), F.count_if(F.col("roi") > 0).alias("winning"), F.avg("roi").alias("mean_roi"),
        F.min("roi").alias("worst_roi"), F.stddev_samp("roi").alias("spread"),
    )


def consensus(df: DataFrame, keys: list[str], side: str, sides: list[str], value: str, book: str) -> DataFrame:
    """Median over books of each side's mean value."""
    per_book = df.groupBy(*keys, book).pivot(side, sides).agg(F.avg(value))
    return per_book.groupBy(*keys).agg(*[F.median(s).alias(f"{s}_median") for s in sides], F.count(F.lit(1)).alias("books"))


def mcnemar(df: DataFrame, a: Column, b: Column, actual: Column) -> DataFrame:
    """Discordant counts and the continuity-corrected statistic (0 without discordance)."""
    only_a, only_b = F.count_if((a == actual) & (b != actual)), F.count_if((a != actual) & (b == actual))
    out = df.agg(only_a.alias("only_a"), only_b.alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    stat = F.pow(F.greatest(F.lit(0), F.abs(F.col("only_a") - F.col("only_b")) - 1), 2) / n
    return out.withColumn("statistic", F.when(n > 0, stat).otherwise(0.0))


def error_metrics(predicted: Column, actual: Column) -> list[Column]:
    gap = predicted - actual
    return [F.count(gap).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias"), F.corr(predicted, actual).alias("corr")]


def bootstrap_auc(df: DataFrame, row: list[str], a: str, b: str, y: str, replicates: int = 1000, seed: int = 42, slices: int = 64) -> DataFrame:
    """One row: the areas under the ROC curves of ``a`` and ``b``, their gap, its mean and deviation over Poisson bootstrap replicates, z and p.

    A row's weights in all replicates are drawn from a hash of its key, so reruns agree, and are the same for both scores. Where rows are read, those of
    one score are added up over all of a task, as vectors of weights with and without the outcome; of many scores a bounded number is held at a time. Slices of scores (0 to 1) are ordered on their own, one pass giving what every
    replicate's area gains there; what lies below a slice is added from the slices' totals.
    """
    wide = replicates + 1
    most = 1 << 21  # numbers that a task holds of each outcome before it passes them on
    parts = "model int, slice int, score double, pos binary, neg binary"
    sums = "model int, slice int, below array<double>, pos array<double>, neg array<double>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            """What is held, in small batches; then nothing is."""
            rows = [[m, int(min(max(s * slices, 0), slices - 1)), s, v[0].tobytes(), v[1].tobytes()] for (m, s), v in held.items()]
            held.clear()
            for lo in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_pylist([dict(zip(("model", "slice", "score", "pos", "neg"), r, strict=True)) for r in rows[lo : lo + 1024]], _schema(parts))

        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                weight = _poisson(some.column("h").to_numpy(), replicates)
                won = some.column("y").to_numpy() > 0
                for model, name in enumerate(("a", "b")):
                    scores, at = np.unique(some.column(name).to_numpy(), return_inverse=True)
                    both = np.zeros((2, len(scores), wide), np.int64)
                    np.add.at(both[0], at[won], weight[won])
                    np.add.at(both[1], at[~won], weight[~won])
                    for i, s in enumerate(scores.tolist()):
                        if (model, s) in held:
                            held[model, s] += both[:, i]
                        else:
                            held[model, s] = both[:, i].copy()
                if len(held) * wide > most:
                    yield from told()
        yield from told()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, score = None, None
        below, pos, neg, tied_pos, tied_neg = (np.zeros(wide) for _ in range(5))

        def settle() -> None:
            below[:] += tied_pos * (neg + tied_neg / 2)
            pos[:], neg[:] = pos + tied_pos, neg + tied_neg
            tied_pos[:], tied_neg[:] = 0, 0

        def told() -> pa.RecordBatch:
            settle()
            row = dict(zip(("model", "slice", "below", "pos", "neg"), (*now, below.tolist(), pos.tolist(), neg.tolist()), strict=True))
            return pa.RecordBatch.from_pylist([row], _schema(sums))

        for batch in batches:
            for r in batch.to_pylist():
                if (key := (r["model"], r["slice"])) != now:
                    if now is not None:
                        yield told()
                    now, score = key, r["score"]
                    for total in (below, pos, neg, tied_pos, tied_neg):
                        total[:] = 0
                if r["score"] != score:
                    settle()
                    score = r["score"]
                tied_pos += np.frombuffer(r["pos"], np.int64)
                tied_neg += np.frombuffer(r["neg"], np.int64)
        if now is not None:
            yield told()

    rows = df.select(F.xxhash64(F.lit(seed), *row).alias("h"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(y).cast("int").alias("y")).dropna()
    gathered = rows.mapInArrow(gather, parts)
    each = gathered.repartition("model", "slice").sortWithinPartitions("model", "slice", "score").mapInArrow(order, sums)
    long = each.select("model", "slice", F.posexplode(F.arrays_zip("below", "pos", "neg")).alias("r", "v")).select("model", "slice", "r", "v.*")
    under = F.coalesce(F.sum("neg").over(Window.partitionBy("model", "r").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    area = F.try_divide(F.sum(F.col("below") + F.col("pos") * F.col("under")), F.sum("pos") * F.sum("neg"))
    sides = long.withColumn("under", under).groupBy("model", "r").agg(area.alias("auc"))
    per = sides.groupBy("r").agg(F.max(F.when(F.col("model") == 0, F.col("auc"))).alias("x"), F.max(F.when(F.col("model") == 1, F.col("auc"))).alias("y"))
    drawn = F.when(F.col("r") > 0, F.col("x") - F.col("y"))
    first = lambda c: F.max(F.when(F.col("r") == 0, F.col(c)))
    out = per.agg(first("x").alias("auc_a"), first("y").alias("auc_b"), F.avg(drawn).alias("mean_gap"), F.stddev_pop(drawn).alias("sd"))
    z = F.when(F.col("sd") > 0, F.col("mean_gap") / F.col("sd")).otherwise(0.0)
    out = out.withColumn("gap", F.col("auc_a") - F.col("auc_b")).withColumn("z", z)
    return out.withColumn("p_value", F.when(F.col("sd") > 0, 2 * (1 - odds.normal_cdf(F.abs("z")))).otherwise(1.0))


def _poisson(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Weights of each key: 1, then draws with mean 1 from a mix of the key's and the replicate's bits."""
    x = keys.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    drawn = np.searchsorted(steps, u, side="right").astype(np.int64)
    return np.concatenate([np.ones((len(keys), 1), np.int64), drawn], axis=1)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])
