"""Chances that players go over their lines, from how earlier projections missed and from what the market says."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.odds import held
from gridspark.operators.walkforward import prior_rates, residual_cdf
from gridspark.sources.scratch import folder, written


def over_probabilities(
    rows: DataFrame, prediction: list[str], order: str, least: int = 100, shrink: float = 50.0, floor: float = 0.02, cap: float = 0.98,
    blend_least: int = 100, blend_strength: float = 6.0, blend_low: float = 0.15, blend_high: float = 0.95,
) -> DataFrame:
    """Decided rows (as of ``props.probability_input``, with implied_probability) with the chance of going over that earlier weeks give, and by which ``method``.

    With ``least`` residuals of the market's earlier weeks: the share of them above what the line needs, drawn to the market's earlier rate of overs by
    ``shrink`` rows (residual_cdf). A prediction with several lines (``prediction`` names its key) gives one residual, that of the last row by ``order``. If ``blend_least`` earlier rows
    have both that chance and the price's, both are blended by their Brier scores (market_residual_blend). Without enough residuals the price stands (market_implied_fallback), and without a price
    the rate of overs, 0.5 before any (base_rate_fallback).
    """
    period = F.col("season") * 100 + F.col("week")
    last = Window.partitionBy(*prediction).orderBy(F.desc(order))
    marked = rows.withColumns({"_period": period, "_over": F.col("actual_over_line").cast("int"), "_residual": F.when(F.row_number().over(last) == 1, F.col("residual")), "_point": -F.col("model_edge")})
    # Tables of a row a market and period are written: the rows meet them as they are read, and are not sorted or shuffled for it.
    root, week = folder(rows.sparkSession, "overs"), ["market", "_period"]
    rates = written(prior_rates(marked, ["market"], "_period", "_over", "_base"), f"{root}/rates")
    counted = residual_cdf(marked, ["market"], "_period", "_residual", "_point", "_cdf", shrink=1.0, base=0.0).join(rates, week, "left")
    n, base = F.col("_cdf_n"), F.coalesce("_base", F.lit(0.5))
    raw = F.col("_cdf") * (n + 1) / F.nullif(n, F.lit(0))
    weight = n / (n + shrink)
    drawn = F.when(n >= least, held(weight * raw + (1 - weight) * base, floor, cap))
    priced = held(F.col("implied_probability"), floor, cap)
    scored = counted.withColumns({"prob_over_market": priced, "prob_over_residual": drawn, "prob_over_raw": F.when(n >= least, held(raw, floor, cap))})
    both = F.col("prob_over_residual").isNotNull() & F.col("prob_over_market").isNotNull()
    miss = lambda c: F.sum(F.when(both, F.pow(F.col(c) - F.col("_over"), 2)))
    per = scored.groupBy("market", "_period").agg(F.count_if(both).alias("_n"), miss("prob_over_residual").alias("_r"), miss("prob_over_market").alias("_m"))
    w = Window.partitionBy("market").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    run = per.select("market", "_period", F.sum("_n").over(w).alias("_n"), F.sum("_r").over(w).alias("_r"), F.sum("_m").over(w).alias("_m"))
    brier = lambda c: F.try_divide(F.col(c), F.col("_n"))
    side = held(0.5 + blend_strength * (brier("_r") - brier("_m")) / F.greatest(brier("_m"), F.lit(1e-6)), blend_low, blend_high)
    weights = written(run.select(*week, F.when(F.col("_n") >= blend_least, side).alias("_w")), f"{root}/weights")
    out = scored.join(weights, week)
    blended = both & F.col("_w").isNotNull()
    fallback = F.coalesce("prob_over_market", held(base, floor, cap))
    p = F.when(blended, held((1 - F.col("_w")) * F.col("prob_over_residual") + F.col("_w") * F.col("prob_over_market"), floor, cap)).otherwise(F.coalesce("prob_over_residual", fallback))
    method = F.when(blended, "market_residual_blend").when(F.col("prob_over_residual").isNotNull(), "residual_cdf").when(F.col("prob_over_market").isNotNull(), "market_implied_fallback").otherwise("base_rate_fallback")
    told = out.withColumns({"prob_over_model": p, "method": method, "market_blend_weight": F.when(blended, F.col("_w")).otherwise(0.0), "calibration_sample_size": n})
    edge, over = F.col("prob_over_model") - F.col("prob_over_market"), F.col("prob_over_model") >= 0.5
    told = told.withColumns({"prob_edge": edge, "probability_pick": F.when(over, "over").otherwise("under"), "probability_pick_correct": over == F.col("actual_over_line")})
    return told.drop("_period", "_over", "_residual", "_point", "_base", "_base_n", "_cdf", "_cdf_n", "_w")
