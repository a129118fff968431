"""Grading of predictions, and what the grades say of calibration, drift and policies."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import odds


def versus_actual(predictions: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with their results, one to one: a key that either side holds twice is an error when it is read.

    Needs home_win_prob, pred_home_margin, home_moneyline, away_moneyline against actual_home_win (null: a tie) and home_margin.
    """
    once = lambda df, side: df.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn(
        "_c", F.when(F.col("_c") > 1, F.raise_error(F.lit(f"{side}: a key comes twice"))).otherwise(F.col("_c"))
    )
    p = odds.held(F.col("home_win_prob"), 0.0, 1.0)
    out = once(predictions, "predictions").filter("_c = 1").drop("_c").join(once(results, "results").filter("_c = 1").drop("_c"), keys)
    out = out.withColumn("home_win_prob", p).withColumn("predicted_home_win", F.col("home_win_prob") >= 0.5)
    right = F.col("predicted_home_win") == F.col("actual_home_win")
    result = F.when(F.col("actual_home_win").isNull(), "push").when(right, "win").when(~right, "loss").otherwise("ungraded")
    price = F.when(F.col("predicted_home_win"), F.col("home_moneyline")).when(~F.col("predicted_home_win"), F.col("away_moneyline"))
    y = F.col("actual_home_win").cast("double")
    safe = lambda x: odds.held(x, 1e-9, 1 - 1e-9)
    return out.withColumns(
        {
            "su_result": result, "model_pick_prob": F.when(F.col("predicted_home_win"), p).otherwise(1 - p), "model_pick_moneyline": price,
            "moneyline_profit_unit": moneyline_profit(result, price), "brier_component": F.pow(p - y, 2),
            "log_loss_component": -(y * F.ln(safe(p)) + (1 - y) * F.ln(safe(1 - p))), "margin_error": F.col("pred_home_margin") - F.col("home_margin"),
        }
    )


def moneyline_profit(result: Column, price: Column) -> Column:
    """Profit of one unit at an American price: a win pays, a loss costs the unit, a push nothing; without a price null."""
    decimal = odds.american_to_decimal(price)
    return F.when(decimal.isNull(), None).when(result == "win", decimal - 1).when(result == "loss", -1.0).when(result == "push", 0.0)


def attach_clv(graded: DataFrame, clv: DataFrame, key: str, pick: str) -> DataFrame:
    """Closing-line values by key; where the pick is another than the graded one they are null and say so."""
    joined = graded.join(clv.select(key, F.col(pick).alias("_pick"), "clv"), key, "left")
    same = F.col("_pick").eqNullSafe(F.col(pick))
    status = F.when(F.col("_pick").isNull(), "missing").when(same, "matched").otherwise("pick_changed")
    return joined.withColumn("clv_status", status).withColumn("clv", F.when(same, F.col("clv"))).drop("_pick")


def no_pick_rows(detail: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The graded rows, and final games that no pick is there for, as no_pick."""
    rest = results.join(detail.select(*keys), keys, "left_anti").withColumn("su_result", F.lit("no_pick"))
    return detail.unionByName(rest.select(*[c for c in rest.columns if c in detail.columns]), allowMissingColumns=True)


def record(keys: list[str], graded: DataFrame, profit: str = "moneyline_profit_unit") -> DataFrame:
    """Wins, losses, pushes, hit rate, units and return by ``keys`` (all rows without any)."""
    w, l, p = (F.count_if(F.col("su_result") == r) for r in ("win", "loss", "push"))
    return graded.groupBy(*keys).agg(
        w.alias("wins"), l.alias("losses"), p.alias("pushes"), F.try_divide(w, w + l).alias("hit_rate"), F.sum(profit).alias("units"),
        F.try_divide(F.sum(profit), F.count(profit)).alias("roi"),
    )


def two_sided_clv(df: DataFrame) -> DataFrame:
    """Both sides of each game: the model's probability against the closing implied one, and the cover probability of the spread.

    The handicap is the home side's points given to it, so pred_margin + spread over 28, around a half, held to 0.01 and 0.99.
    """
    cover = odds.held(0.5 + (F.col("pred_margin") + F.col("home_spread")) / 28, 0.01, 0.99)
    rows = F.array(
        F.struct(F.lit("home").alias("side"), F.col("p").alias("model"), odds.american_to_implied(F.col("home_close")).alias("close"), cover.alias("cover")),
        F.struct(F.lit("away").alias("side"), (1 - F.col("p")).alias("model"), odds.american_to_implied(F.col("away_close")).alias("close"), (1 - cover).alias("cover")),
    )
    return df.select("game_id", F.inline(rows)).withColumn("clv", F.col("model") - F.col("close"))


def spread_of(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, mean, median, deviation and share above 0."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_samp(v).alias("sd"), F.avg((v > 0).cast("double")).alias("positive")
    )


def key_numbers(df: DataFrame, line: str, keys: list[float], tolerance: float, segments: dict[str, Column], aggregates: list[Column]) -> DataFrame:
    """Aggregates for every key number a line lies within ``tolerance`` of and every segment a row is in, "all" among them.

    Rows are unfolded by the short lists of the keys and segments they belong to, so nothing is crossed.
    """
    near = F.filter(F.array(*[F.lit(float(k)) for k in keys]), lambda k: F.abs(F.abs(F.col(line)) - k) <= tolerance)
    named = F.filter(F.array(F.lit("all"), *[F.when(c, F.lit(n)) for n, c in segments.items()]), lambda s: s.isNotNull())
    each = df.withColumn("key_number", F.explode(near)).withColumn("segment", F.explode(named))
    return each.groupBy("key_number", "segment").agg(*aggregates)


def confidence_status(bins: DataFrame, least: int = 30, most_over: float = 0.05, from_prob: float = 0.6) -> DataFrame:
    """Bins (min_confidence, n, mean_p, rate) with the empirical rate as the recalibrated probability, and what they are good for."""
    error = F.col("mean_p") - F.col("rate")
    high, enough, over, under = F.col("min_confidence") >= from_prob, F.col("n") >= least, error > most_over, error < -most_over
    status = F.when(~high, "diagnostic_only").when(~enough, "insufficient_sample").when(over, "overconfident")
    status = status.when(under, "underconfident_conservative").otherwise("calibrated_for_confidence")
    return bins.withColumns({"recalibrated": F.col("rate"), "raw_minus_recalibrated": error, "status": status, "recommended": high & enough & ~over})


def confidence_gate(bins: DataFrame, least: int = 25, most_over: float = 0.07, from_prob: float = 0.55) -> DataFrame:
    """One row: whether bins (bin, min_confidence, n, mean_p, rate) of the games where model and market disagree let a policy through.

    Counted are confident bins with ``least`` graded games; one whose mean probability lies more than ``most_over`` above its rate blocks. The row names all that fail, the worst
    first, and what the worst should have said.
    """
    error = F.col("mean_p") - F.col("rate")
    counted = (F.col("min_confidence") >= from_prob) & (F.col("n") >= least) & error.isNotNull()
    failed = F.sort_array(F.collect_list(F.when(counted & (error > most_over), F.struct((-error).alias("e"), (-F.col("n")).alias("n"), F.col("bin").cast("string").alias("bin"), "rate"))))
    out = bins.agg(F.count(F.lit(1)).alias("bins"), F.count_if(counted).alias("evaluated_bins"), failed.alias("f"))
    status = F.when(F.col("bins") == 0, "no_matching_confidence_bins").when(F.col("evaluated_bins") == 0, "insufficient_high_confidence_sample")
    status = status.when(F.size("f") == 0, "model_confidence_calibration_pass").otherwise("blocked_model_confidence_overconfidence")
    worst = F.try_element_at("f", F.lit(1))
    return out.select(
        (status == "model_confidence_calibration_pass").alias("pass"), status.alias("status"), "evaluated_bins", F.array_join(F.transform("f", lambda x: x["bin"]), ";").alias("failed_bins"),
        worst["bin"].alias("worst_bin"), (-worst["e"]).alias("worst_error"), worst["rate"].alias("worst_recalibrated_prob"),
    )


def cover_tiers(bins: DataFrame, least: int, most_error: float) -> DataFrame:
    """Spread-cover bins (n, mean_p, rate) as tiers: insufficient, miscalibrated, lean, playable."""
    error = F.abs(F.col("mean_p") - F.col("rate"))
    tier = F.when(F.col("n") < least, "insufficient").when(error > most_error, "miscalibrated").when(F.col("rate") < 0.5238, "lean").otherwise("playable")
    return bins.withColumn("tier", tier)


#: What is compared with the model as it is, and what kind of change each would be.
STRATEGIES = {"vegas_novig": "reference", "vegas_blend_50_50": "blend", "confidence_shrink": "shrink", "disagreement_shrink": "shrink"}
_METRICS = ("brier", "log_loss", "auc", "accuracy", "roi")


def recalibration_decision(summary: DataFrame, baseline: str = "current_model", least: int = 250, least_disagreement: int = 50) -> DataFrame:
    """One row a strategy of STRATEGIES: its metrics against the baseline's, over all games and where model and market disagree, both gates, and the layer to change.

    Summary: segment (all, disagree), strategy, n, brier, log_loss, auc, accuracy, roi. Over all games a strategy has to better Brier score and log loss on ``least`` games, to lose no more than 0.005
    accuracy and no return on disagreements; on those, over ``least_disagreement`` games, to better both and the return. What is not there is null, and passes only
    where it says so.
    """
    sides = {"overall": "all", "disagreement": "disagree"}
    sums = []
    for name, segment in sides.items():
        here = F.col("segment") == segment
        sums += [F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias(f"{name}_n"), *[F.max(F.when(here, F.col(m))).alias(f"{name}_{m}") for m in _METRICS]]
    wide = summary.groupBy("strategy").agg(*sums)  # as many rows as there are strategies
    names = summary.sparkSession.createDataFrame(list(STRATEGIES.items()), "strategy string, kind string")
    base = wide.filter(F.col("strategy") == baseline).select(*[F.col(f"{s}_{m}").alias(f"_{s}_{m}") for s in sides for m in _METRICS], F.lit(1).alias("_one"))
    out = names.join(wide, "strategy", "left").na.fill(0, [f"{s}_n" for s in sides]).join(F.broadcast(base), F.lit(1) == F.col("_one"), "left")
    out = out.select("strategy", "kind", *[f"{s}_n" for s in sides], *[(F.col(f"{s}_{m}") - F.col(f"_{s}_{m}")).alias(f"{s}_{m}_delta") for s in sides for m in _METRICS])
    d = lambda s, m: F.col(f"{s}_{m}_delta")
    yes = lambda c: F.coalesce(c, F.lit(False))
    safe = lambda c: F.coalesce(c, F.lit(True))
    lift = (F.col("overall_n") >= least) & yes(d("overall", "brier") < 0) & yes(d("overall", "log_loss") < 0)
    overall = lift & safe(d("overall", "accuracy") >= -0.005) & safe(d("disagreement", "roi") >= 0)
    policy = (F.col("disagreement_n") >= least_disagreement) & yes(d("disagreement", "brier") < 0) & yes(d("disagreement", "log_loss") < 0) & yes(d("disagreement", "roi") > 0)
    kind = F.col("kind")
    steps = [
        ((kind == "reference") & lift, "market_reference_beats_model", "benchmark_only"), ((kind == "blend") & overall & policy, "market_blend_probability_and_policy_candidate", "market_blend"),
        ((kind == "blend") & lift, "market_blend_probability_research_only", "research"), ((kind == "shrink") & overall & policy, "base_and_market_candidate", "both"),
        ((kind == "shrink") & overall, "base_probability_candidate", "base_model"), ((kind == "shrink") & lift, "base_probability_research_only", "research"),
        (policy, "market_policy_only_candidate", "market_policy"), (F.lit(True), "no_live_change", "none"),
    ]
    first = lambda i: F.coalesce(*[F.when(s[0], s[i]) for s in steps])
    told = {"passes_overall_gate": overall, "passes_disagreement_gate": policy, "decision": first(1), "recommended_layer": first(2)}
    return out.withColumns(told).drop("kind")


#: Families of segments that say what was done and not what was played; they are not recommended.
RESULT_FAMILIES = ("blend_followed", "moneyline_clv_segment")


def recommendations(
    segments: DataFrame, season: str = "season", least: int = 25, least_season: int = 5, least_seasons: int = 2, positive: float = 0.55, least_roi: float = 0.0, least_gain: float = 0.0
) -> DataFrame:
    """What to do with each segment that has ``least`` games over all seasons (null ``season``): back the model, back the blend, avoid the model, or watch.

    Rows: family, segment, season, n, model_roi, market_roi, blend_n, blend_roi. The model's side is a candidate if it gains, and gains on the market's, over all seasons and in a share of ``positive`` of at least ``least_seasons``
    seasons of ``least_season`` games; the blend's if it gains and beats both on ``least`` games. Ordered by ``tier`` and ``score``.
    """
    rows = segments.withColumn("gain", F.col("model_roi") - F.col("market_roi")).filter(~F.col("family").isin(*RESULT_FAMILIES))
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    per = rows.filter(F.col(season).isNotNull() & (F.col("n") >= least_season)).groupBy("family", "segment").agg(
        F.count(F.lit(1)).alias("seasons"), rate(F.col("model_roi") > least_roi).alias("positive_roi_rate"), rate(F.col("gain") > least_gain).alias("positive_gain_rate")
    )
    out = rows.filter(F.col(season).isNull() & (F.col("n") >= least)).drop(season).join(per, ["family", "segment"], "left").na.fill(0, ["seasons"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    model = (F.col("seasons") >= least_seasons) & yes((F.col("positive_roi_rate") >= positive) & (F.col("positive_gain_rate") >= positive))
    model = model & yes((F.col("model_roi") > least_roi) & (F.col("gain") > least_gain))
    blend = yes((F.col("blend_n") >= least) & (F.col("blend_roi") > 0) & (F.col("blend_roi") > F.col("model_roi")) & (F.col("blend_roi") > F.col("market_roi")))
    avoid = yes((F.col("model_roi") < 0) & (F.col("gain") < 0))
    steps = [
        (model, "candidate_model_side_segment", "research", F.col("model_roi") + F.col("gain")), (blend, "candidate_market_blend_segment", "research", 2 * F.col("blend_roi") - F.col("model_roi")),
        (avoid, "avoid_model_side_segment", "block", F.abs("model_roi") + F.abs("gain")), (F.lit(True), "monitor", "monitor", F.coalesce("gain", F.lit(0.0))),
    ]
    first = lambda i: F.coalesce(*[F.when(s[0], s[i]) for s in steps])
    return out.withColumns({"action": first(1), "tier": first(2), "score": first(3)})


def bias_monitor(df: DataFrame, keys: list[str], model: str, market: str, y: str) -> DataFrame:
    """By ``keys``: mean gap to the market, its size, share below, t, and what shifting the model by the mean gap does to its Brier score."""
    gap = F.col(model) - F.col(market)
    means = df.groupBy(*keys).agg(
        F.count(gap).alias("n"), F.avg(gap).alias("mean_gap"), F.avg(F.abs(gap)).alias("mean_abs_gap"), F.avg((gap < 0).cast("double")).alias("share_below"),
        F.stddev_samp(gap).alias("_sd"),
    )
    moved = df.join(means.select(*keys, "mean_gap"), keys)
    shifted = odds.held(F.col(model) - F.col("mean_gap"), 0.01, 0.99)
    scores = moved.groupBy(*keys).agg(
        (F.avg(F.pow(F.col(model) - F.col(y), 2)) - F.avg(F.pow(F.col(market) - F.col(y), 2))).alias("brier_delta"),
        (F.avg(F.pow(shifted - F.col(y), 2)) - F.avg(F.pow(F.col(model) - F.col(y), 2))).alias("brier_of_shift"),
    )
    t = F.when(F.col("n") > 2, F.try_divide(F.col("mean_gap") * F.sqrt("n"), F.col("_sd")))
    return means.withColumn("t_stat", t).drop("_sd").join(scores, keys)


def drift(current: DataFrame, baseline: DataFrame, keys: list[str], thresholds: dict[str, float]) -> DataFrame:
    """Metrics of two tables side by side, by how much each moved, and how grave that is.

    A move beyond the metric's threshold, up or down, is a warning, beyond twice of it critical; a smaller one, or one without both values, is none.
    """
    long = lambda df, n: df.unpivot(keys, list(thresholds), "metric", n)
    out = long(current, "now").join(long(baseline, "then"), [*keys, "metric"])
    most = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("metric")]
    moved = F.abs(F.col("now") - F.col("then"))
    severity = F.when(moved > 2 * most, "critical").when(moved > most, "warning").otherwise("none")
    return out.withColumns({"drift": F.col("now") - F.col("then"), "threshold": most, "severity": severity})


def paired_t(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """t of the paired differences, by ``keys``."""
    gap = F.col(a) - F.col(b)
    out = df.groupBy(*keys).agg(F.count(gap).alias("n"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("sd"))
    return out.withColumn("t", F.try_divide(F.col("mean") * F.sqrt("n"), F.col("sd")))


def bootstrap_gap(df: DataFrame, row: list[str], loss_a: Column, loss_b: Column, replicates: int, seed: int) -> DataFrame:
    """One row: the difference of two mean losses, its deviation over Poisson bootstrap replicates, and z.

    A row's weight in a replicate is drawn from a hash of both, so reruns agree. Each row is unfolded into its replicates and summed at once
    where it is read: what is shuffled are ``replicates`` rows a task.
    """
    #: The least hash, as its first seven hex digits, that passes each step of the distribution; texts of hex digits order like their numbers.
    least, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(9):
        total += p
        least.append(math.floor(total * (1 << 28) - 0.5) + 1)
        p /= k + 1
    weight = sum(((F.col("_h") >= F.lit(f"{n:07x}")).cast("int") for n in least if n < 1 << 28), F.lit(0))
    named = F.when(F.coalesce(*[F.col(c).cast("string") for c in row]).isNotNull(), F.concat_ws("|", *[F.col(c).cast("string") for c in row]))
    draws = F.posexplode(F.array(*[F.lit(f"{seed}|{b}") for b in range(replicates + 1)])).alias("_b", "_draw")
    each = df.select((loss_a - loss_b).alias("_gap"), named.alias("_row")).select("_gap", "_row", draws)
    # The hash is a column before it is compared: one a row and replicate.
    each = each.select("_b", "_gap", F.md5(F.concat_ws("|", "_draw", "_row")).alias("_h")).select("_b", "_gap", F.when(F.col("_b") == 0, 1).otherwise(weight).alias("_w"))
    per = each.groupBy("_b").agg(F.try_divide(F.sum(F.col("_w") * F.col("_gap")), F.sum("_w")).alias("gap"))
    out = per.agg(F.max(F.when(F.col("_b") == 0, F.col("gap"))).alias("gap"), F.stddev_samp(F.when(F.col("_b") > 0, F.col("gap"))).alias("sd"))
    return out.withColumn("z", F.try_divide(F.col("gap"), F.col("sd")))


def window_metrics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, deviation, least and most of each metric over windows, one row a metric."""
    long = df.unpivot([], metrics, "metric", "v") if metrics else df
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"))


def kpi_rows(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Numbers of several summaries as one long table: source, keys, kpi, value. A key that a summary lacks is null."""
    parts = []
    for name, df in tables.items():
        values = [c for c in df.columns if c not in keys]
        wide = df.select(*[F.col(k).cast("string").alias(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in keys], *[F.col(v).cast("double").alias(v) for v in values])
        parts.append(wide.unpivot(keys, values, "kpi", "value").withColumn("source", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def isotonic_blocks(df: DataFrame, score: str, y: str, bins: int) -> DataFrame:
    """Non-decreasing rates over ``bins`` equal bins of the score in [0, 1]: the greatest of the least means, for each bin.

    The level of a bin is the maximum over all bins up to it of the minimum over all from it of the mean between both; with a bounded
    number of bins that is a join of bins with bins, whatever the number of rows.
    """
    cell = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    sums = df.groupBy(cell.alias("bin")).agg(F.sum(y).cast("double").alias("s"), F.count(y).cast("double").alias("c"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.select("bin", F.sum("s").over(w).alias("S"), F.sum("c").over(w).alias("C"), (F.sum("s").over(w) - F.col("s")).alias("S0"), (F.sum("c").over(w) - F.col("c")).alias("C0"))
    a = run.select(F.col("bin").alias("lo"), F.col("S0"), F.col("C0"))
    b = run.select(F.col("bin").alias("hi"), F.col("S"), F.col("C"))
    means = a.join(b, F.col("lo") <= F.col("hi")).select("lo", "hi", ((F.col("S") - F.col("S0")) / (F.col("C") - F.col("C0"))).alias("m"))
    least = means.withColumn("least", F.min("m").over(Window.partitionBy("lo").orderBy(F.desc("hi"))))
    return least.groupBy(F.col("hi").alias("bin")).agg(F.max("least").alias("level"))
