"""Reports on predictions of games made of orders, and inputs of volatile games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import odds
from gridspark.operators import evaluation
from gridspark.plans.prop_queries import _auc_sql
from gridspark.plans.registry import query, table
from gridspark.sources import feeds

DECIDED_SQL = """o AS (SELECT *, YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, o_orderkey // 3 AS game_id FROM orders), pr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY o_orderkey DESC) AS i FROM o),
  d AS (SELECT game_id, season, week, 'T' || o_custkey % 32 AS home_team, 'T' || (o_custkey + 1 + o_orderkey % 31) % 32 AS away_team, GREATEST(0, LEAST(1, (o_custkey % 103) / 100.0::DOUBLE)) AS q, (o_custkey % 41 - 20)::DOUBLE AS pm, (game_id % 29 - 14)::DOUBLE AS m FROM pr WHERE i = 1 AND game_id % 29 <> 14 AND game_id % 7 > 0),
  e AS (SELECT *, (m > 0)::INT AS y, (q >= 0.5) <> (m > 0) AS missed, ABS(pm - m) AS ae FROM d)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders are three versions of a prediction; some games are not over, some are tied."""
    cust, key, game = F.col("o_custkey"), F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 3)
    team = lambda n: F.concat(F.lit("T"), (n % 32).cast("string"))
    predictions = table(spark, sf_dir, "orders").select(
        game.alias("game_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), team(cust).alias("home_team"), team(cust + 1 + key % 31).alias("away_team"),
        ((cust % 103) / 100.0).alias("home_win_prob"), (cust % 41 - 20).cast("double").alias("pred_home_margin"), key.alias("made_at"),
    )
    actuals = predictions.select("game_id").distinct().select("game_id", F.when(F.col("game_id") % 7 > 0, (F.col("game_id") % 29 - 14).cast("double")).alias("home_margin"))
    return evaluation.decided(predictions, actuals, ["game_id"], "made_at")


METRICS_SQL = "COUNT(*) AS n_games, ROUND(AVG((NOT missed)::INT), 7) AS accuracy, ROUND(AVG((q - y) ** 2), 10) AS brier, ROUND(AVG(-(y * LN(GREATEST(1e-9::DOUBLE, LEAST(1 - 1e-9::DOUBLE, q))) + (1 - y) * LN(GREATEST(1e-9::DOUBLE, LEAST(1 - 1e-9::DOUBLE, 1 - q))))), 10) AS log_loss, ROUND(AVG(ae), 7) AS mae_margin, ROUND(SQRT(AVG(ae * ae)), 7) AS rmse_margin"


@query("weekly_metrics", f"WITH {DECIDED_SQL}, s AS (SELECT season, week, {METRICS_SQL} FROM e GROUP BY 1, 2) SELECT s.*, ROUND(a.auc, 7) AS auc FROM s JOIN {_auc_sql('e', 'q', 'y', ['season', 'week'])} a USING (season, week)")
def weekly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.metrics(["season", "week"], _decided(spark, sf_dir))
    return out.withColumns({c: F.round(c, 10 if c in ("brier", "log_loss") else 7) for c in ("accuracy", "brier", "log_loss", "mae_margin", "rmse_margin", "auc")})


@query(
    "probability_bin_report",
    f"""WITH {DECIDED_SQL}, x AS (SELECT i AS bin, i / 10.0 AS low, (i + 1) / 10.0 AS high FROM range(10) t(i))
    SELECT bin::INT AS bin, low::DOUBLE AS low, high::DOUBLE AS high, COUNT(q) AS n_games, ROUND(AVG(q), 7) AS mean_prob, ROUND(AVG(y), 7) AS actual_win_rate, ROUND(AVG(pm - m), 7) AS mean_margin_error FROM x LEFT JOIN e ON q > low AND q <= high GROUP BY ALL""",
)
def probability_bin_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.probability_bins(_decided(spark, sf_dir)).withColumns({c: F.round(c, 7) for c in ("mean_prob", "actual_win_rate", "mean_margin_error")})


@query(
    "team_error_summary",
    f"""WITH {DECIDED_SQL}, t AS (SELECT home_team AS team, ae, missed FROM e UNION ALL SELECT away_team, ae, missed FROM e)
    SELECT team, COUNT(*) AS n_games, ROUND(AVG(ae), 7) AS mean_abs_margin_error, ROUND(AVG(missed::INT), 7) AS misclassified_rate FROM t GROUP BY 1""",
)
def team_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.team_errors(_decided(spark, sf_dir)).withColumns({c: F.round(c, 7) for c in ("mean_abs_margin_error", "misclassified_rate")})


@query(
    "worst_predictions",
    f"""WITH {DECIDED_SQL}, a AS (SELECT game_id, 'margin' AS report, ae AS value FROM e ORDER BY ae DESC, game_id LIMIT 10), b AS (SELECT game_id, 'confidence' AS report, ABS(q - 0.5) AS value FROM e WHERE missed AND ABS(q - 0.5) >= 0.2 ORDER BY 3 DESC, game_id LIMIT 10)
    SELECT game_id, report, ROUND(value, 7) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def worst_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest misses of either kind are the report."""
    return evaluation.worst(_decided(spark, sf_dir)).withColumn("value", F.round("value", 7))


MARKET_SQL = f"""{DECIDED_SQL}, f AS (SELECT o_orderkey // 3 AS game_id, o_orderkey AS k, CASE WHEN o_custkey % 13 > 0 THEN 100 / (200 + o_custkey % 150)::DOUBLE END AS h, (110 + o_custkey % 90) / (210 + o_custkey % 90)::DOUBLE AS a FROM orders),
  mk AS (SELECT game_id, arg_max(p, k) FILTER (WHERE p IS NOT NULL) AS p0, MAX(k) AS k, arg_max(COALESCE(p, -1), k) AS p FROM (SELECT game_id, k, CASE WHEN h IS NOT NULL THEN GREATEST(0.0001, LEAST(0.9999, h / (h + a))) END AS p FROM f) GROUP BY 1),
  z AS (SELECT e.*, NULLIF(mk.p, -1) AS market_prob, LEAST(0.99, q * 0.9 + 0.05) AS shrunk FROM e JOIN mk USING (game_id)), w AS (SELECT *, CASE WHEN week <= 4 THEN 'early' WHEN week <= 9 THEN 'mid' WHEN week <= 14 THEN 'late' ELSE 'closing' END AS week_bucket FROM z WHERE market_prob IS NOT NULL),
  r AS (SELECT season::VARCHAR AS season, week_bucket, y, unnest(['home_win_prob', 'shrunk', 'market_prob']) AS source, GREATEST(1e-6, LEAST(1 - 1e-6, unnest([q, shrunk, market_prob]))) AS q FROM w),
  s AS (SELECT source, COALESCE(season, 'all') AS season, COALESCE(week_bucket, 'all') AS week_bucket, COUNT(*) AS n_games, AVG((q - y) ** 2) AS brier, AVG(-(y * LN(q) + (1 - y) * LN(1 - q))) AS logloss, AVG(((q >= 0.5) = (y = 1))::INT) AS accuracy FROM r GROUP BY GROUPING SETS ((source), (source, season), (source, week_bucket))),
  c AS (SELECT source, 'all' AS season, 'all' AS week_bucket, auc FROM {_auc_sql('r', 'q', 'y', ['source'])} UNION ALL SELECT source, season, 'all', auc FROM {_auc_sql('r', 'q', 'y', ['source', 'season'])} UNION ALL SELECT source, 'all', week_bucket, auc FROM {_auc_sql('r', 'q', 'y', ['source', 'week_bucket'])}),
  t AS (SELECT s.*, auc FROM s JOIN c USING (source, season, week_bucket))"""


@query(
    "model_against_market",
    f"""WITH {MARKET_SQL} SELECT t.source, t.season, t.week_bucket, t.n_games, {', '.join(f'ROUND(t.{c}, 7) AS {c}, ROUND(t.{c} - b.{c}, 7) AS {c}_minus_market' for c in ('brier', 'logloss', 'accuracy', 'auc'))} FROM t JOIN t b ON b.source = 'market_prob' AND b.season = t.season AND b.week_bucket = t.week_bucket""",
)
def model_against_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of probabilities against the no-vig price, on the games that have all three."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    features = table(spark, sf_dir, "orders").select(
        F.floor(key / 3).alias("game_id"), key.alias("k"), F.when(cust % 13 > 0, odds.american_to_implied((100 + cust % 150).cast("double"))).alias("implied_home"), odds.american_to_implied((-(110 + cust % 90)).cast("double")).alias("implied_away")
    )
    rows = evaluation.attach_market(_decided(spark, sf_dir), features, "k").withColumn("shrunk", F.least(F.lit(0.99), F.col("home_win_prob") * 0.9 + 0.05))
    out = evaluation.against_market(rows, ["home_win_prob", "shrunk"])
    return out.withColumns({c: F.round(c, 7) for c, kind in out.dtypes if kind == "double"})


VOLATILE_SQL = """g AS (SELECT o_orderkey AS game_id, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 30)::DOUBLE END AS wind, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 100)::DOUBLE END AS kick, (o_custkey % 90)::DOUBLE AS temp, (4 + o_custkey % 9)::DOUBLE AS hr, CASE WHEN o_orderkey % 6 > 0 THEN (4 + o_orderkey % 9)::DOUBLE END AS ar,
  CASE WHEN o_custkey % 8 = 0 THEN 1.0 END AS outh, (o_orderkey % 3 = 0)::INT AS resa, (o_custkey % 2 = 0) AS dome, (o_orderkey % 3000)::DOUBLE AS km, (o_custkey % 4)::DOUBLE AS tz, CASE WHEN o_orderkey % 5 > 0 THEN (o_custkey % 101) / 100.0 ELSE 1.5 END::DOUBLE AS p, (o_custkey % 41 - 20)::DOUBLE AS pm FROM orders)"""


@query(
    "volatility_matrix",
    f"""WITH {VOLATILE_SQL}, h AS (SELECT *, COALESCE(kick, temp) AS t, CASE WHEN p BETWEEN 0 AND 1 THEN p END AS q, COALESCE(outh, 0) AS now, resa AS rec, CASE WHEN dome THEN 1 ELSE 0 END AS ind FROM g)
    SELECT game_id, COALESCE(wind, 0) AS wind_mph, t AS temp_f, ABS(t - 60) AS weather_temp_deviation, COALESCE(wind, 0) * ABS(t - 60) AS wind_temp_interaction, t - temp AS weather_temp_delta, 0.0::DOUBLE AS wind_mph_delta, (now + rec)::DOUBLE AS qb_uncertainty_score, (now + rec > 0)::INT::DOUBLE AS qb_uncertain,
      now::DOUBLE AS qb_uncertainty_recent, (now - rec)::DOUBLE AS qb_uncertainty_trend, (LEAST(hr, COALESCE(ar, 99)) <= 6)::INT::DOUBLE AS short_rest, 0.0::DOUBLE AS back_to_back_travel, ind::DOUBLE AS indoor_game, 1.0::DOUBLE - ind AS outdoor_game, hr AS home_rest, COALESCE(ar, 0) AS away_rest,
      {', '.join(f'{v} AS {c}' for c, v in (("away_travel_distance_km", "km"), ("timezone_diff_hours_abs", "tz"), ("travel_km_short_rest", "CASE WHEN hr <= 6 THEN km ELSE 0 END"))) },
      {', '.join(f'0.0::DOUBLE AS {c}' for c in evaluation.VOLATILE_AS_IS if c not in ("home_rest", "away_rest", "away_travel_distance_km", "timezone_diff_hours_abs", "travel_km_short_rest"))},
      km * tz AS travel_timezone_product, (hr <= 6 AND km > 0)::INT::DOUBLE AS travel_short_rest_flag, km * GREATEST(0, 7 - COALESCE(ar, 0)) AS travel_rest_pressure, COALESCE(hr - ar, 0) AS rest_diff, 0.0::DOUBLE AS rest_days_diff, ROUND(COALESCE(ABS(q - 0.5), 0), 9) AS model_confidence_abs,
      ROUND(COALESCE(1 - 2 * ABS(q - 0.5), 0), 9) AS model_uncertainty, ROUND(CASE WHEN q IS NULL THEN 0 ELSE ABS(LN(GREATEST(1e-6, LEAST(1 - 1e-6, q)) / (1 - GREATEST(1e-6, LEAST(1 - 1e-6, q))))) END, 7) AS model_logit_abs, ABS(pm) AS pred_margin_abs, ROUND((EXP(ABS(pm) / 7) - 1) / (EXP(ABS(pm) / 7) + 1), 9) AS pred_margin_confidence,
      ROUND(COALESCE(ABS(ABS(q - 0.5) - (EXP(ABS(pm) / 7) - 1) / (EXP(ABS(pm) / 7) + 1)), 0), 9) AS model_margin_disagreement FROM h""",
)
def volatility_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with some of the columns; what the table lacks is 0 in the matrix."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    d = lambda c: c.cast("double")
    home_rest = d(4 + cust % 9)
    games = table(spark, sf_dir, "orders").select(
        key.alias("game_id"), F.when(cust % 5 > 0, d(cust % 30)).alias("wind"), F.when(cust % 4 > 0, d(cust % 100)).alias("weather_temp_kickoff_f"), d(cust % 90).alias("temp"), home_rest.alias("home_rest"), F.when(key % 6 > 0, d(4 + key % 9)).alias("away_rest"),
        F.when(cust % 8 == 0, 1.0).alias("inj_qb_out_home"), (key % 3 == 0).cast("int").alias("inj_qb_reserve_rolling3_away"), (cust % 2 == 0).alias("roof_is_dome"), d(key % 3000).alias("away_travel_distance_km"), d(cust % 4).alias("timezone_diff_hours_abs"),
        F.when(home_rest <= 6, d(key % 3000)).otherwise(0.0).alias("travel_km_short_rest"), F.when(key % 5 > 0, (cust % 101) / 100.0).otherwise(1.5).alias("home_win_prob"), d(cust % 41 - 20).alias("pred_home_margin"),
    )
    out = evaluation.volatility_matrix(games, ["game_id"])
    places = {"model_confidence_abs": 9, "model_uncertainty": 9, "model_logit_abs": 7, "pred_margin_confidence": 9, "model_margin_disagreement": 9}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(
    "shrunk_volatile_games",
    """WITH g AS (SELECT o_orderkey AS game_id, (o_custkey % 97 + 2) / 100.0::DOUBLE AS p, (o_custkey % 41 - 20)::DOUBLE AS m, CASE WHEN o_custkey % 9 > 0 THEN (o_orderkey % 11) / 10.0::DOUBLE END AS v, CASE WHEN o_custkey % 6 > 0 THEN 0.4 + (o_custkey % 20) / 100.0::DOUBLE END AS h, 0.55::DOUBLE AS a, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 15 - 7)::DOUBLE END AS s FROM orders),
    f AS (SELECT *, COALESCE(v, 0) >= 0.5 AS on_, COALESCE(h / (h + a), 0.5) AS t, COALESCE(s, 0) AS l FROM g)
    SELECT game_id, ROUND(CASE WHEN on_ THEN t + (p - t) * (1 - 0.6 * v) ELSE p END, 8) AS home_win_prob, ROUND(CASE WHEN on_ THEN l + (m - l) * (1 - 0.3 * v) ELSE m END, 8) AS pred_home_margin, on_::INT AS volatile FROM f""",
)
def shrunk_volatile_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatile games drawn to the market's probability and line, where there are such."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("game_id"), ((cust % 97 + 2) / 100.0).alias("home_win_prob"), (cust % 41 - 20).cast("double").alias("pred_home_margin"), F.when(cust % 9 > 0, (key % 11) / 10.0).alias("volatility_prob"),
        F.when(cust % 6 > 0, 0.4 + (cust % 20) / 100.0).alias("implied_home"), F.lit(0.55).alias("implied_away"), F.when(cust % 4 > 0, cust % 15 - 7).alias("spread_close_home"),
    )
    out = evaluation.shrink_volatile(rows, 0.5, 0.6, 0.3)
    return out.select("game_id", F.round("home_win_prob", 8).alias("home_win_prob"), F.round("pred_home_margin", 8).alias("pred_home_margin"), "volatile")


@query(
    "feed_injuries",
    """SELECT c_nationkey AS week, 'T' || c_custkey % 32 AS team, c_custkey::VARCHAR AS id, c_name AS display_name, CASE WHEN c_custkey % 3 > 0 THEN 'Questionable' ELSE c_mktsegment END AS injury_status, c_mktsegment AS injury_type, c_acctbal::DECIMAL(18, 2)::VARCHAR AS injury_detail FROM customer""",
)
def feed_injuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per nation; where the status is missing the type stands for it."""
    one = F.struct(
        F.when(F.col("c_custkey") % 3 > 0, "Questionable").alias("status"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("detail"),
        F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("displayName")).alias("athlete"), F.struct(F.concat(F.lit("T"), (F.col("c_custkey") % 32).cast("string")).alias("abbreviation")).alias("team"),
    )
    feed = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("week")).agg(F.to_json(F.struct(F.collect_list(one).alias("injuries"))).alias("payload"))
    return feeds.injuries(feed).select("week", "team", "id", "display_name", "injury_status", "injury_type", "injury_detail")


@query("news_in_season", "SELECT o_orderkey, 1998 AS season FROM orders WHERE o_orderdate >= '1997-06-01' AND o_orderdate <= '1999-03-01'")
def news_in_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("published"))
    return feeds.in_season(news, 1998).drop("published")


@query("unstarted_games", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate > '1999-05-05 00:00:00'")
def unstarted_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in part are games whose kickoff is not known."""
    at = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp"))
    return evaluation.unstarted(table(spark, sf_dir, "orders"), F.lit("1999-05-05 00:00:00").cast("timestamp"), at).select("o_orderkey")


@query(
    "replaced_week",
    "WITH g AS (SELECT o_orderkey AS game_id, YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, o_totalprice AS grade FROM orders) SELECT game_id, season, week, CASE WHEN season = 1999 AND week = 5 THEN -grade ELSE grade END AS grade FROM g WHERE NOT (season = 1999 AND week = 5 AND grade < 100000)",
)
def replaced_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cumulative table of grades with one week graded anew."""
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").cast("bigint").alias("season"), F.month("o_orderdate").cast("bigint").alias("week"), F.col("o_totalprice").alias("grade"))
    new = stored.filter("season = 1999 AND week = 5 AND grade >= 100000").withColumn("grade", -F.col("grade"))
    return evaluation.replace_week(stored, new, 1999, 5)


@query(
    "top_features",
    "WITH v AS (SELECT unnest(['tax', 'discount', 'quantity']) AS feature, unnest([l_tax - 0.04, l_discount - 0.05, l_quantity / 100]) AS value FROM lineitem) SELECT feature, ROUND(AVG(ABS(value)), 8) AS mean_abs, ROUND(AVG(value), 8) AS mean FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2",
)
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two that weigh most are the report."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_tax") - 0.04).alias("tax"), (F.col("l_discount") - 0.05).alias("discount"), (F.col("l_quantity") / 100).alias("quantity"))
    out = evaluation.top_features(lines.unpivot([], ["tax", "discount", "quantity"], "feature", "value"), 2)
    return out.withColumns({"mean_abs": F.round("mean_abs", 8), "mean": F.round("mean", 8)})


@query(
    "blend_detail",
    """WITH g AS (SELECT o_orderkey AS game_id, YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, o_custkey % 2 = 0 AS mp FROM orders), b AS (SELECT l_orderkey AS game_id, l_returnflag <> 'N' AS bp, l_tax > 0.04 AS bc, l_discount - 0.05 AS pr,
      ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS i FROM lineitem WHERE l_quantity > 20)
    SELECT g.game_id, bp IS NOT NULL AS blend_available, bp AS blend_home_pick, bc AS blend_correct, pr AS blend_profit, CASE WHEN bp = mp THEN 'model' WHEN bp <> mp THEN 'vegas' ELSE 'unavailable' END AS blend_followed FROM g LEFT JOIN b ON b.game_id = g.game_id AND i = 1""",
)
def blend_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games on which model and market differ, their last larger line as what the blend picked."""
    games = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), (F.col("o_custkey") % 2 == 0).alias("model_home_pick"), (F.col("o_custkey") % 2 != 0).alias("market_home_pick")
    )
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 20").select(
        F.col("l_orderkey").alias("game_id"), (F.col("l_returnflag") != "N").alias("blend_home_pick"), (F.col("l_tax") > 0.04).alias("blend_correct"), (F.col("l_discount") - 0.05).alias("blend_profit"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seen"),
    )
    blend = lines.join(games.select("game_id", "season", "week"), "game_id")
    return evaluation.attach_blend(games, blend, "seen").select("game_id", "blend_available", "blend_home_pick", "blend_correct", "blend_profit", "blend_followed")
