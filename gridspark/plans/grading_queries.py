"""Grades of predictions on games made of orders, and what follows from bets on their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import grading
from gridspark.plans.aggregate_queries import BETS_SQL, graded
from gridspark.plans.registry import query, table

GAMES_SQL = """games AS (SELECT o_orderkey AS game_id, YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, (o_custkey % 97 + 2) / 100.0::DOUBLE AS p, (o_custkey % 41 - 20)::DOUBLE AS pm,
  (CASE WHEN o_custkey % 3 = 0 THEN 110 + o_custkey % 90 ELSE -(105 + o_custkey % 95) END)::DOUBLE AS hm, (CASE WHEN o_custkey % 3 = 0 THEN -(120 + o_custkey % 90) WHEN o_custkey % 3 = 1 THEN 100 + o_custkey % 95 END)::DOUBLE AS am,
  (o_orderkey % 29 - 14)::DOUBLE AS hmargin FROM orders),
  g AS (SELECT *, CASE WHEN hmargin = 0 THEN NULL ELSE hmargin > 0 END AS won, p >= 0.5 AS pick FROM games),
  d AS (SELECT game_id, season, week, p, pick, hmargin, pm, CASE WHEN won IS NULL THEN 'push' WHEN pick = won THEN 'win' ELSE 'loss' END AS su_result, CASE WHEN pick THEN hm ELSE am END AS price, won FROM g),
  r AS (SELECT *, CASE WHEN price IS NULL THEN NULL WHEN su_result = 'win' THEN CASE WHEN price > 0 THEN price / 100 ELSE 100 / ABS(price) END WHEN su_result = 'loss' THEN -1.0 ELSE 0.0 END::DOUBLE AS profit FROM d)"""


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    third = cust % 3
    return table(spark, sf_dir, "orders").select(
        key.alias("game_id"), F.year("o_orderdate").cast("bigint").alias("season"), F.month("o_orderdate").cast("bigint").alias("week"), ((cust % 97 + 2) / 100.0).alias("p"),
        (cust % 41 - 20).cast("double").alias("pm"), F.when(third == 0, 110 + cust % 90).otherwise(-(105 + cust % 95)).cast("double").alias("hm"),
        F.when(third == 0, -(120 + cust % 90)).when(third == 1, 100 + cust % 95).cast("double").alias("am"), (key % 29 - 14).cast("double").alias("hmargin"),
    )


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = _games(spark, sf_dir)
    predictions = games.select("game_id", "season", "week", F.col("p").alias("home_win_prob"), F.col("pm").alias("pred_home_margin"), F.col("hm").alias("home_moneyline"), F.col("am").alias("away_moneyline"))
    results = games.select("game_id", "season", "week", F.col("hmargin").alias("home_margin"), F.when(F.col("hmargin") != 0, F.col("hmargin") > 0).alias("actual_home_win"))
    return grading.versus_actual(predictions, results, ["season", "week", "game_id"])


@query(
    "grade_predictions",
    f"""WITH {GAMES_SQL} SELECT game_id, su_result, ROUND(CASE WHEN pick THEN p ELSE 1 - p END, 6) AS model_pick_prob, price AS model_pick_moneyline, ROUND(profit, 8) AS moneyline_profit_unit,
      ROUND((p - won::INT) ** 2, 8) AS brier_component, ROUND(-(won::INT * LN(p) + (1 - won::INT) * LN(1 - p)), 8) AS log_loss_component, pm - hmargin AS margin_error FROM r""",
)
def grade_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return _detail(spark, sf_dir).select(
        "game_id", "su_result", r("model_pick_prob", 6), "model_pick_moneyline", r("moneyline_profit_unit", 8), r("brier_component", 8), r("log_loss_component", 8), "margin_error"
    )


@query(
    "grade_clv",
    f"""WITH {GAMES_SQL}, c AS (SELECT game_id, CASE WHEN game_id % 5 = 0 THEN NOT pick ELSE pick END AS pick, pm / 100 AS clv FROM g WHERE week > 2)
    SELECT r.game_id, CASE WHEN c.pick IS NULL THEN 'missing' WHEN c.pick = r.pick THEN 'matched' ELSE 'pick_changed' END AS clv_status, CASE WHEN c.pick = r.pick THEN clv END AS clv FROM r LEFT JOIN c USING (game_id)""",
)
def grade_clv(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = _detail(spark, sf_dir)
    changed = F.when(F.col("game_id") % 5 == 0, ~F.col("predicted_home_win")).otherwise(F.col("predicted_home_win")).alias("predicted_home_win")
    clv = detail.filter("week > 2").select("game_id", changed, (F.col("pred_home_margin") / 100).alias("clv"))
    return grading.attach_clv(detail, clv, "game_id", "predicted_home_win").select("game_id", "clv_status", "clv")


@query("no_pick_rows", f"WITH {GAMES_SQL} SELECT game_id, season, hmargin AS home_margin, CASE WHEN week <= 6 THEN su_result ELSE 'no_pick' END AS su_result FROM r")
def no_pick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = _detail(spark, sf_dir).filter("week <= 6").select("game_id", "season", "home_margin", "su_result")
    results = _games(spark, sf_dir).select("game_id", "season", F.col("hmargin").alias("home_margin"))
    return grading.no_pick_rows(detail, results, ["game_id"])


@query(
    "season_record",
    f"""WITH {GAMES_SQL} SELECT season, COUNT(*) FILTER (WHERE su_result = 'win') AS wins, COUNT(*) FILTER (WHERE su_result = 'loss') AS losses, COUNT(*) FILTER (WHERE su_result = 'push') AS pushes,
      ROUND(COUNT(*) FILTER (WHERE su_result = 'win') / COUNT(*) FILTER (WHERE su_result <> 'push')::DOUBLE, 6) AS hit_rate, ROUND(SUM(profit), 5) AS units, ROUND(SUM(profit) / COUNT(profit), 6) AS roi FROM r GROUP BY 1""",
)
def season_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grading.record(["season"], _detail(spark, sf_dir))
    return out.withColumns({"hit_rate": F.round("hit_rate", 6), "units": F.round("units", 5), "roi": F.round("roi", 6)})


CLV_SQL = """c AS (SELECT game_id, hm, am, p, CASE WHEN hm > 0 THEN 100 / (hm + 100) ELSE ABS(hm) / (ABS(hm) + 100) END AS ch, CASE WHEN am > 0 THEN 100 / (am + 100) WHEN am < 0 THEN ABS(am) / (ABS(am) + 100) END AS ca,
  GREATEST(0.01, LEAST(0.99, 0.5 + (pm - hmargin / 2) / 28)) AS cv FROM games),
  s AS (SELECT game_id, 'home' AS side, p AS model, ch AS close, cv AS cover FROM c UNION ALL SELECT game_id, 'away', 1 - p, ca, 1 - cv FROM c)"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = _games(spark, sf_dir).select("game_id", "p", F.col("hm").alias("home_close"), F.col("am").alias("away_close"), F.col("pm").alias("pred_margin"), (-F.col("hmargin") / 2).alias("home_spread"))
    return grading.two_sided_clv(games)


@query("two_sided_clv", f"WITH {GAMES_SQL}, {CLV_SQL} SELECT game_id, side, ROUND(close, 8) AS close, ROUND(cover, 8) AS cover, ROUND(model - close, 8) AS clv FROM s")
def two_sided_clv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).select("game_id", "side", *[F.round(c, 8).alias(c) for c in ("close", "cover", "clv")])


@query(
    "clv_analysis",
    f"""WITH {GAMES_SQL}, {CLV_SQL}, v AS (SELECT side, ROUND(model - close, 6) AS clv FROM s WHERE close IS NOT NULL)
    SELECT side, COUNT(*) AS n, ROUND(AVG(clv), 6) AS mean, ROUND(QUANTILE_CONT(clv, 0.5), 6) AS median, ROUND(STDDEV_SAMP(clv), 6) AS sd, ROUND(AVG((clv > 0)::INT), 6) AS positive FROM v GROUP BY 1""",
)
def clv_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grading.spread_of(_sides(spark, sf_dir).withColumn("clv", F.round("clv", 6)), "clv", ["side"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "sd", "positive")})


@query(
    "spread_key_numbers",
    f"""WITH {GAMES_SQL}, e AS (SELECT *, unnest(list_filter([3.0, 7.0, 10.0], lambda k: ABS(ABS(pm) - k) <= 0.5)) AS key_number FROM r),
    f AS (SELECT *, unnest(list_filter(['all', CASE WHEN pick THEN 'home' END, CASE WHEN p > 0.8 THEN 'sure' END, CASE WHEN price > 0 THEN 'dog' END], lambda s: s IS NOT NULL)) AS segment FROM e)
    SELECT key_number::DOUBLE AS key_number, segment, COUNT(*) AS n, COUNT(*) FILTER (WHERE su_result = 'win') AS wins, ROUND(SUM(profit), 5) AS units FROM f GROUP BY 1, 2""",
)
def spread_key_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = {"home": F.col("predicted_home_win"), "sure": F.col("home_win_prob") > 0.8, "dog": F.col("model_pick_moneyline") > 0}
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("su_result") == "win").alias("wins"), F.round(F.sum("moneyline_profit_unit"), 5).alias("units")]
    return grading.key_numbers(_detail(spark, sf_dir), "pred_home_margin", [3, 7, 10], 0.5, segments, sums)


BINS_SQL = f"""WITH {BETS_SQL}, b AS (SELECT FLOOR(p * 10 + 0.000001) / 10 AS min_confidence, COUNT(*) AS n, ROUND(AVG(p), 8) AS mean_p, ROUND(AVG(y), 8) AS rate FROM graded WHERE season = 1999 GROUP BY 1),
  s AS (SELECT *, CASE WHEN min_confidence < 0.4 THEN 'diagnostic_only' WHEN n < 500 THEN 'insufficient_sample' WHEN mean_p - rate > 0.005 THEN 'overconfident' WHEN mean_p - rate < -0.005 THEN 'underconfident_conservative' ELSE 'calibrated_for_confidence' END AS status,
    min_confidence >= 0.4 AND n >= 500 AND NOT mean_p - rate > 0.005 AS recommended FROM b)"""


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = graded(spark, sf_dir).filter("season = 1999").withColumn("min_confidence", F.floor(F.col("p") * 10 + 0.000001) / 10)
    return bets.groupBy("min_confidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 8).alias("mean_p"), F.round(F.avg("y"), 8).alias("rate"))


@query(
    "confidence_recalibration",
    f"{BINS_SQL} SELECT min_confidence, n, rate AS recalibrated, ROUND(mean_p - rate, 7) AS raw_minus_recalibrated, status, recommended FROM s",
)
def confidence_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grading.confidence_status(_bins(spark, sf_dir), 500, 0.005, 0.4)
    return out.select("min_confidence", "n", "recalibrated", F.round("raw_minus_recalibrated", 7).alias("raw_minus_recalibrated"), "status", "recommended")


@query(
    "confidence_gate",
    f"""{BINS_SQL}, o AS (SELECT min_confidence::VARCHAR AS bin, n, mean_p - rate AS e, rate FROM b WHERE min_confidence >= 0.4 AND n >= 500),
    w AS (SELECT *, ROW_NUMBER() OVER (ORDER BY e DESC, n DESC, bin) AS i FROM o WHERE e > 0.001), x AS (SELECT (SELECT COUNT(*) FROM o) AS k, (SELECT COUNT(*) FROM w) AS f)
    SELECT f = 0 AND k > 0 AS pass, CASE WHEN k = 0 THEN 'insufficient_high_confidence_sample' WHEN f = 0 THEN 'model_confidence_calibration_pass' ELSE 'blocked_model_confidence_overconfidence' END AS status,
      k AS evaluated_bins, COALESCE((SELECT string_agg(bin, ';' ORDER BY i) FROM w), '') AS failed_bins, (SELECT bin FROM w WHERE i = 1) AS worst_bin, ROUND((SELECT e FROM w WHERE i = 1), 7) AS worst_error, (SELECT rate FROM w WHERE i = 1) AS worst_recalibrated_prob FROM x""",
)
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = _bins(spark, sf_dir).withColumn("bin", F.col("min_confidence").cast("string"))
    return grading.confidence_gate(bins, 500, 0.001, 0.4).withColumn("worst_error", F.round("worst_error", 7))


@query(
    "cover_tiers",
    f"{BINS_SQL} SELECT min_confidence, n, CASE WHEN n < 700 THEN 'insufficient' WHEN ABS(mean_p - rate) > 0.01 THEN 'miscalibrated' WHEN rate < 0.5238 THEN 'lean' ELSE 'playable' END AS tier FROM s",
)
def cover_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.cover_tiers(_bins(spark, sf_dir), 700, 0.01).select("min_confidence", "n", "tier")


DECISION_SQL = f"""WITH {BETS_SQL}, e AS (SELECT y, profit, odds, unnest(['current_model', 'vegas_novig', 'vegas_blend_50_50', 'confidence_shrink']) AS strategy, unnest([p, mp, (p + mp) / 2, 0.5 + (p - 0.5) * 0.9]) AS q, (p >= 0.5) <> (mp >= 0.5) AS differs
      FROM (SELECT *, CASE WHEN odds > 0 THEN 100 / (odds + 100) ELSE ABS(odds) / (ABS(odds) + 100) END AS mp FROM graded)),
    f AS (SELECT *, unnest(['all', CASE WHEN differs THEN 'disagree' END]) AS segment FROM e), r AS (SELECT segment, strategy, q, SUM(y) AS pos, COUNT(*) AS n FROM f WHERE segment IS NOT NULL GROUP BY 1, 2, 3),
    u AS (SELECT *, COALESCE(SUM(n - pos) OVER (PARTITION BY segment, strategy ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r),
    a AS (SELECT segment, strategy, SUM(pos * (below + (n - pos) / 2.0)) / (SUM(pos) * SUM(n - pos)) AS auc FROM u GROUP BY 1, 2),
    s AS (SELECT segment, strategy, COUNT(*) AS n, ROUND(AVG((q - y) ** 2), 7) AS brier, ROUND(AVG(-(y * LN(q) + (1 - y) * LN(1 - q))), 7) AS log_loss, ROUND(AVG(((q >= 0.5) = (y = 1))::INT), 7) AS accuracy, ROUND(AVG(CASE WHEN q >= 0.5 THEN profit END), 7) AS roi FROM f WHERE segment IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT s.*, ROUND(auc, 7) AS auc FROM s JOIN a USING (segment, strategy)), b AS (SELECT * FROM t WHERE strategy = 'current_model'),
    d AS (SELECT x.strategy, x.kind, t.segment, t.n, t.brier - b.brier AS db, t.log_loss - b.log_loss AS dl, t.auc - b.auc AS da, t.accuracy - b.accuracy AS dc, t.roi - b.roi AS dr
      FROM (VALUES ('vegas_novig', 'reference'), ('vegas_blend_50_50', 'blend'), ('confidence_shrink', 'shrink'), ('disagreement_shrink', 'shrink')) x(strategy, kind) LEFT JOIN t ON t.strategy = x.strategy LEFT JOIN b ON b.segment = t.segment),
    w AS (SELECT strategy, kind, {", ".join(f"COALESCE(MAX(n) FILTER (WHERE segment = '{g}'), 0) AS {s}_n, " + ", ".join(f"MAX({c}) FILTER (WHERE segment = '{g}') AS {s}_{m}_delta" for m, c in (("brier", "db"), ("log_loss", "dl"), ("auc", "da"), ("accuracy", "dc"), ("roi", "dr"))) for s, g in (("overall", "all"), ("disagreement", "disagree")))} FROM d GROUP BY 1, 2),
    l AS (SELECT *, overall_n >= 250 AND COALESCE(overall_brier_delta < 0, FALSE) AND COALESCE(overall_log_loss_delta < 0, FALSE) AS lift FROM w),
    g AS (SELECT *, lift AND COALESCE(overall_accuracy_delta >= -0.005, TRUE) AND COALESCE(disagreement_roi_delta >= 0, TRUE) AS o, disagreement_n >= 50 AND COALESCE(disagreement_brier_delta < 0, FALSE) AND COALESCE(disagreement_log_loss_delta < 0, FALSE) AND COALESCE(disagreement_roi_delta > 0, FALSE) AS p FROM l),
    h AS (SELECT *, CASE WHEN kind = 'reference' AND lift THEN ['market_reference_beats_model', 'benchmark_only'] WHEN kind = 'blend' AND o AND p THEN ['market_blend_probability_and_policy_candidate', 'market_blend'] WHEN kind = 'blend' AND lift THEN ['market_blend_probability_research_only', 'research']
      WHEN kind = 'shrink' AND o AND p THEN ['base_and_market_candidate', 'both'] WHEN kind = 'shrink' AND o THEN ['base_probability_candidate', 'base_model'] WHEN kind = 'shrink' AND lift THEN ['base_probability_research_only', 'research'] WHEN p THEN ['market_policy_only_candidate', 'market_policy'] ELSE ['no_live_change', 'none'] END AS c FROM g)
    SELECT strategy, overall_n, disagreement_n, {", ".join(f"ROUND({s}_{m}_delta, 6) AS {s}_{m}_delta" for s in ("overall", "disagreement") for m in ("brier", "log_loss", "auc", "accuracy", "roi"))}, o AS passes_overall_gate, p AS passes_disagreement_gate, c[1] AS decision, c[2] AS recommended_layer FROM h"""


@query("recalibration_decision", DECISION_SQL)
def recalibration_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bets' probabilities as the model, the prices' as the market; the last strategy has no rows."""
    from gridspark.functions import odds
    from gridspark.operators import aggregates

    p, mp, y = F.col("p"), odds.american_to_implied(F.col("odds")), F.col("y")
    told = {"current_model": p, "vegas_novig": mp, "vegas_blend_50_50": (p + mp) / 2, "confidence_shrink": 0.5 + (p - 0.5) * 0.9}
    rows = F.array(*[F.named_struct(F.lit("strategy"), F.lit(n), F.lit("q"), q) for n, q in told.items()])
    segments = F.array_compact(F.array(F.lit("all"), F.when((p >= 0.5) != (mp >= 0.5), "disagree")))
    each = graded(spark, sf_dir).select("y", "profit", F.explode(segments).alias("segment"), rows.alias("r")).select("y", "profit", "segment", F.inline("r"))
    q, keys = F.col("q"), ["segment", "strategy"]
    summary = each.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(q - y, 2)), 7).alias("brier"), F.round(F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))), 7).alias("log_loss"),
        F.round(F.avg(((q >= 0.5) == (y == 1)).cast("int")), 7).alias("accuracy"), F.round(F.avg(F.when(q >= 0.5, F.col("profit"))), 7).alias("roi"),
    ).join(aggregates.auc(each, "q", "y", keys).withColumn("auc", F.round("auc", 7)), keys)
    out = grading.recalibration_decision(summary)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_delta")})


@query(
    "segment_recommendations",
    f"""WITH {BETS_SQL}, m AS (SELECT *, CASE WHEN odds > 0 THEN 100 / (odds + 100) ELSE ABS(odds) / (ABS(odds) + 100) END AS mp FROM graded), z AS (SELECT *, CASE WHEN mp >= 0.5 THEN profit END AS mprofit, CASE WHEN ABS(p - mp) < 0.1 THEN profit END AS bprofit FROM m),
    x AS (SELECT 'segment' AS family, segment, season, profit, mprofit, bprofit FROM z UNION ALL SELECT 'market', market, season, profit, mprofit, bprofit FROM z UNION ALL SELECT 'week', week::VARCHAR, season, profit, mprofit, bprofit FROM z UNION ALL SELECT 'blend_followed', segment, season, profit, mprofit, bprofit FROM z),
    g AS (SELECT family, segment, season, COUNT(*) AS n, ROUND(AVG(profit), 7) AS model_roi, ROUND(AVG(mprofit), 7) AS market_roi, COUNT(bprofit) AS blend_n, ROUND(AVG(bprofit), 7) AS blend_roi FROM x WHERE family <> 'blend_followed' GROUP BY GROUPING SETS ((family, segment, season), (family, segment))),
    h AS (SELECT *, model_roi - market_roi AS gain FROM g), s AS (SELECT family, segment, COUNT(*) AS seasons, AVG(COALESCE(model_roi > 0, FALSE)::INT) AS pr, AVG(COALESCE(gain > 0, FALSE)::INT) AS pg FROM h WHERE season IS NOT NULL AND n >= 5 GROUP BY 1, 2),
    j AS (SELECT h.* EXCLUDE (season), COALESCE(seasons, 0) AS seasons, pr, pg FROM h LEFT JOIN s USING (family, segment) WHERE season IS NULL AND n >= 25),
    k AS (SELECT *, seasons >= 2 AND pr >= 0.55 AND pg >= 0.55 AND model_roi > 0 AND gain > 0 AS m, COALESCE(blend_n >= 25 AND blend_roi > 0 AND blend_roi > model_roi AND blend_roi > market_roi, FALSE) AS b, COALESCE(model_roi < 0 AND gain < 0, FALSE) AS v FROM j)
    SELECT family, segment, n, model_roi, market_roi, blend_n, blend_roi, ROUND(gain, 6) AS gain, seasons, ROUND(pr, 6) AS positive_roi_rate, ROUND(pg, 6) AS positive_gain_rate,
      CASE WHEN m THEN 'candidate_model_side_segment' WHEN b THEN 'candidate_market_blend_segment' WHEN v THEN 'avoid_model_side_segment' ELSE 'monitor' END AS action, CASE WHEN m OR b THEN 'research' WHEN v THEN 'block' ELSE 'monitor' END AS tier,
      ROUND(CASE WHEN m THEN model_roi + gain WHEN b THEN 2 * blend_roi - model_roi WHEN v THEN ABS(model_roi) + ABS(gain) ELSE COALESCE(gain, 0) END, 6) AS score FROM k""",
)
def segment_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of segments of the bets, one of them about results and so left out."""
    from gridspark.functions import odds

    mp = odds.american_to_implied(F.col("odds"))
    bets = graded(spark, sf_dir).withColumns({"m": F.when(mp >= 0.5, F.col("profit")), "b": F.when(F.abs(F.col("p") - mp) < 0.1, F.col("profit"))})
    families = F.array(*[F.struct(F.lit(f).alias("family"), F.col(c).cast("string").alias("value")) for f, c in (("segment", "segment"), ("market", "market"), ("week", "week"), ("blend_followed", "segment"))])
    each = bets.select("season", "profit", "m", "b", F.inline(families)).withColumnRenamed("value", "segment")
    sums = [
        F.count(F.lit(1)).alias("n"), F.round(F.avg("profit"), 7).alias("model_roi"), F.round(F.avg("m"), 7).alias("market_roi"), F.count("b").alias("blend_n"), F.round(F.avg("b"), 7).alias("blend_roi"),
    ]
    c = F.col
    segments = each.groupingSets([[c("family"), c("segment"), c("season")], [c("family"), c("segment")]], "family", "segment", "season").agg(*sums)
    out = grading.recommendations(segments)
    return out.withColumns({n: F.round(n, 6) for n in ("gain", "positive_roi_rate", "positive_gain_rate", "score")})


@query(
    "bias_monitor",
    f"""WITH {BETS_SQL}, m AS (SELECT season, p, y, CASE WHEN odds > 0 THEN 100 / (odds + 100) ELSE ABS(odds) / (ABS(odds) + 100) END AS mp FROM graded),
    a AS (SELECT season, COUNT(*) AS n, AVG(p - mp) AS g, AVG(ABS(p - mp)) AS ag, AVG((p < mp)::INT) AS b, STDDEV_SAMP(p - mp) AS sd FROM m GROUP BY 1)
    SELECT season, n, ROUND(g, 7) AS mean_gap, ROUND(ag, 7) AS mean_abs_gap, ROUND(b, 7) AS share_below, ROUND(g * SQRT(n) / sd, 4) AS t_stat, ROUND(AVG((p - y) ** 2) - AVG((mp - y) ** 2), 7) AS brier_delta,
      ROUND(AVG((GREATEST(0.01, LEAST(0.99, p - g)) - y) ** 2) - AVG((p - y) ** 2), 7) AS brier_of_shift FROM m JOIN a USING (season) GROUP BY season, n, g, ag, b, sd""",
)
def bias_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridspark.functions import odds

    bets = graded(spark, sf_dir).withColumn("mp", odds.american_to_implied(F.col("odds"))).withColumn("season", F.col("season").cast("bigint"))
    out = grading.bias_monitor(bets, ["season"], "p", "mp", "y")
    return out.withColumns({c: F.round(c, 7) for c in ("mean_gap", "mean_abs_gap", "share_below", "brier_delta", "brier_of_shift")}).withColumn("t_stat", F.round("t_stat", 4))


@query(
    "drift_check",
    f"""WITH {BETS_SQL}, s AS (SELECT market, season, ROUND(AVG((p - y) ** 2), 7) AS brier, ROUND(AVG(y), 7) AS rate FROM graded WHERE season IN (1998, 1999) GROUP BY 1, 2),
    l AS (SELECT market, season, unnest(['brier', 'rate']) AS metric, unnest([brier, rate]) AS v, unnest([0.0005, 0.002]) AS most FROM s)
    SELECT a.market, a.metric, a.v AS "now", b.v AS "then", ROUND(a.v - b.v, 6) AS drift, a.most::DOUBLE AS threshold, CASE WHEN ABS(a.v - b.v) > 2 * a.most THEN 'critical' WHEN ABS(a.v - b.v) > a.most THEN 'warning' ELSE 'none' END AS severity
    FROM l a JOIN l b USING (market, metric) WHERE a.season = 1999 AND b.season = 1998""",
)
def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute moves of Brier score and rate from one season to the next."""
    bets = graded(spark, sf_dir)
    sums = [F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 7).alias("brier"), F.round(F.avg("y"), 7).alias("rate")]
    of = lambda s: bets.filter(F.col("season") == s).groupBy("market").agg(*sums)
    return grading.drift(of(1999), of(1998), ["market"], {"brier": 0.0005, "rate": 0.002}).withColumn("drift", F.round("drift", 6))


@query(
    "paired_t",
    f"""WITH {BETS_SQL}, m AS (SELECT market, (p - y) ** 2 AS a, (0.5 + (p - 0.5) * 0.9 - y) ** 2 AS b FROM graded)
    SELECT market, COUNT(*) AS n, ROUND(AVG(a - b), 8) AS mean, ROUND(STDDEV_SAMP(a - b), 8) AS sd, ROUND(AVG(a - b) * SQRT(COUNT(*)) / STDDEV_SAMP(a - b), 4) AS t FROM m GROUP BY 1""",
)
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    bets = graded(spark, sf_dir).withColumns({"a": F.pow(p - y, 2), "b": F.pow(0.5 + (p - 0.5) * 0.9 - y, 2)})
    out = grading.paired_t(bets, "a", "b", ["market"])
    return out.withColumns({"mean": F.round("mean", 8), "sd": F.round("sd", 8), "t": F.round("t", 4)})


def _poisson_sql(u: str) -> str:
    """Weight of a draw: how many of the Poisson distribution's steps it passes."""
    steps, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(9):
        total += p
        steps.append(f"({u} > {total!r})::INT")
        p /= k + 1
    return " + ".join(steps)


@query(
    "bootstrap_loss_gap",
    f"""WITH {BETS_SQL}, d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (p - y) ** 2 - (0.5 + (p - 0.5) * 0.9 - y) ** 2 AS gap FROM graded),
    e AS (SELECT b, gap, (('0x' || substr(md5(concat_ws('|', '42', b, l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 7))::INT + 0.5::DOUBLE) / 268435456 AS u FROM d, range(41) r(b)),
    w AS (SELECT b, gap, CASE WHEN b = 0 THEN 1 ELSE {_poisson_sql('u')} END AS w FROM e), g AS (SELECT b, SUM(w * gap) / SUM(w) AS gap FROM w GROUP BY 1),
    t AS (SELECT MAX(gap) FILTER (WHERE b = 0) AS gap, STDDEV_SAMP(gap) FILTER (WHERE b > 0) AS sd FROM g) SELECT ROUND(gap, 9) AS gap, ROUND(sd, 9) AS sd, ROUND(gap / sd, 5) AS z FROM t""",
)
def bootstrap_loss_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of the bets' probabilities against shrunk ones, with the deviation over forty replicates."""
    p, y = F.col("p"), F.col("y")
    loss = lambda q: F.pow(q - y, 2)
    out = grading.bootstrap_gap(graded(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], loss(p), loss(0.5 + (p - 0.5) * 0.9), 40, 42)
    return out.withColumns({"gap": F.round("gap", 9), "sd": F.round("sd", 9), "z": F.round("z", 5)})


@query(
    "window_metric_summary",
    f"""WITH {BETS_SQL}, s AS (SELECT season, ROUND(AVG((p - y) ** 2), 7) AS brier, ROUND(AVG(profit), 7) AS roi FROM graded GROUP BY 1), l AS (SELECT unnest(['brier', 'roi']) AS metric, unnest([brier, roi]) AS v FROM s)
    SELECT metric, ROUND(AVG(v), 7) AS mean, ROUND(STDDEV_SAMP(v), 7) AS sd, MIN(v) AS least, MAX(v) AS most FROM l GROUP BY 1""",
)
def window_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = graded(spark, sf_dir).groupBy("season").agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 7).alias("brier"), F.round(F.avg("profit"), 7).alias("roi"))
    out = grading.window_metrics(per.select("brier", "roi"), ["brier", "roi"])
    return out.withColumns({"mean": F.round("mean", 7), "sd": F.round("sd", 7)})


@query(
    "kpi_rows",
    f"""WITH {BETS_SQL}, a AS (SELECT market, COUNT(*)::DOUBLE AS bets, ROUND(AVG(y), 7) AS rate FROM graded GROUP BY 1), b AS (SELECT season, COUNT(*)::DOUBLE AS bets FROM graded GROUP BY 1)
    SELECT 'market' AS source, market, NULL::VARCHAR AS season, unnest(['bets', 'rate']) AS kpi, unnest([bets, rate]) AS value FROM a UNION ALL SELECT 'season', NULL, season::VARCHAR, 'bets', bets FROM b""",
)
def kpi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = graded(spark, sf_dir)
    a = bets.groupBy("market").agg(F.count(F.lit(1)).alias("bets"), F.round(F.avg("y"), 7).alias("rate"))
    return grading.kpi_rows({"market": a, "season": bets.groupBy("season").agg(F.count(F.lit(1)).alias("bets"))}, ["market", "season"])


@query(
    "isotonic_calibration",
    f"""WITH {BETS_SQL}, b AS (SELECT LEAST(19, FLOOR(p * 20))::INT AS bin, SUM(won::INT)::DOUBLE AS s, COUNT(*)::DOUBLE AS c FROM graded GROUP BY 1),
    m AS (SELECT x.bin AS lo, z.bin AS hi, (SELECT SUM(s) / SUM(c) FROM b WHERE b.bin BETWEEN x.bin AND z.bin) AS m FROM b x JOIN b z ON x.bin <= z.bin),
    l AS (SELECT lo, hi, MIN(m) OVER (PARTITION BY lo ORDER BY hi DESC) AS least FROM m) SELECT hi AS bin, ROUND(MAX(least), 8) AS level FROM l GROUP BY 1""",
)
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.isotonic_blocks(graded(spark, sf_dir), "p", "y", 20).withColumn("level", F.round("level", 8))
