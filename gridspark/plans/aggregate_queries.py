"""Evaluation aggregates on bets made of order lines: a price, a probability and an outcome for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import bins, odds
from gridspark.operators import aggregates as agg
from gridspark.operators import reshape, walkforward
from gridspark.plans.registry import query, table

BETS_SQL = """bets AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, YEAR(l_shipdate) AS season, MONTH(l_shipdate) AS week, l_linestatus AS segment, l_returnflag AS market,
  (CASE WHEN l_partkey % 2 = 0 THEN 100 + l_partkey % 150 ELSE -(100 + l_partkey % 200) END)::DOUBLE AS odds, (l_suppkey % 90 + 5) / 100.0::DOUBLE AS p,
  (l_orderkey % 100 < l_suppkey % 90 + 5) AS won, l_extendedprice / 1000 - l_quantity AS residual FROM lineitem),
graded AS (SELECT *, won::INT AS y, CASE WHEN won THEN CASE WHEN odds > 0 THEN odds / 100 ELSE 100 / ABS(odds) END ELSE -1.0 END AS profit,
  p * CASE WHEN odds > 0 THEN odds / 100 ELSE 100 / ABS(odds) END - (1 - p) AS ev FROM bets)"""

RECORD_SQL = """COUNT(profit) AS bets, COUNT(*) FILTER (WHERE profit > 0) AS wins, COUNT(*) FILTER (WHERE profit < 0) AS losses,
  ROUND(COUNT(*) FILTER (WHERE profit > 0) / NULLIF(COUNT(*) FILTER (WHERE profit <> 0), 0)::DOUBLE, 6) AS hit_rate, ROUND(SUM(profit) / NULLIF(COUNT(profit), 0), 6) AS roi"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    price = F.when(part % 2 == 0, 100 + part % 150).otherwise(-(100 + part % 200)).cast("double")
    bets = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"),
        F.col("l_linestatus").alias("segment"), F.col("l_returnflag").alias("market"), price.alias("odds"), ((supp % 90 + 5) / 100.0).alias("p"),
        (F.col("l_orderkey") % 100 < supp % 90 + 5).alias("won"), (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("residual"),
    )
    return bets.withColumns({
        "y": F.col("won").cast("int"), "profit": odds.american_profit(F.col("odds"), F.col("won")),
        "ev": odds.expected_value(F.col("p"), odds.american_to_decimal(F.col("odds"))),
    })


def _record(df: DataFrame) -> DataFrame:
    return df.drop("pushes").withColumns({c: F.round(c, 6) for c in ("hit_rate", "roi")})


@query("groupby_ratio", "SELECT l_suppkey, SUM(l_quantity) AS q, ROUND(SUM(l_extendedprice) / NULLIF(SUM(l_quantity), 0), 4) AS price, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def groupby_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.round(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")), 4).alias("price"), F.countDistinct("l_partkey").alias("parts")
    )


@query(
    "two_level_agg",
    """WITH d AS (SELECT l_suppkey, l_orderkey, SUM(l_quantity) AS q, MIN(l_linenumber) AS first, MAX(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, COUNT(*) AS drives, ROUND(AVG(q), 5) AS mean_q, AVG(CASE WHEN first = 1 THEN CAST(ROUND(top * 100) AS BIGINT) END) AS opening_top FROM d GROUP BY 1""",
)
def two_level_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    drives = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("q"), F.min("l_linenumber").alias("first"), F.max("l_extendedprice").alias("top"))
    return drives.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("drives"), F.round(F.avg("q"), 5).alias("mean_q"), F.avg(F.when(F.col("first") == 1, F.round(F.col("top") * 100).cast("bigint"))).alias("opening_top")
    )


@query("threshold_sweep", f"WITH {BETS_SQL} SELECT t.threshold, {RECORD_SQL} FROM (VALUES (0.0::DOUBLE), (0.25), (0.5), (9.0)) AS t(threshold) LEFT JOIN graded ON ev > threshold GROUP BY 1")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.threshold_sweep(graded(spark, sf_dir), "ev", [0.0, 0.25, 0.5, 9.0], agg.bet_record(F.col("profit")))
    return _record(out).fillna(0, ["bets", "wins", "losses"])


@query(
    "scope_rollup",
    f"""WITH {BETS_SQL} SELECT COALESCE(season::VARCHAR, 'all') AS season, COALESCE(segment, 'all') AS segment, {RECORD_SQL} FROM graded
    GROUP BY GROUPING SETS ((), (season), (segment), (season, segment))""",
)
def scope_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record(agg.scope_rollup(graded(spark, sf_dir), [[], ["season"], ["segment"], ["season", "segment"]], agg.bet_record(F.col("profit"))))


@query(
    "overlapping_segments",
    f"""WITH {BETS_SQL} SELECT segment, {RECORD_SQL} FROM (SELECT 'favourite' AS segment, profit FROM graded WHERE odds < 0 UNION ALL SELECT 'underdog', profit FROM graded WHERE odds > 0
      UNION ALL SELECT 'close', profit FROM graded WHERE ABS(odds) <= 120 UNION ALL SELECT 'late', profit FROM graded WHERE week >= 9) GROUP BY 1""",
)
def overlapping_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("odds")
    named = {"favourite": price < 0, "underdog": price > 0, "close": F.abs(price) <= 120, "late": F.col("week") >= 9}
    return _record(reshape.explode_segments(graded(spark, sf_dir), named).groupBy("segment").agg(*agg.bet_record(F.col("profit"))))


@query(
    "season_stability",
    f"""WITH {BETS_SQL}, s AS (SELECT market, season, COUNT(*) AS n, AVG(profit) AS roi FROM graded GROUP BY 1, 2 HAVING COUNT(*) >= 100)
    SELECT market, COUNT(*) AS seasons, COUNT(*) FILTER (WHERE roi > 0) AS winning, ROUND(AVG(roi), 6) AS mean_roi, ROUND(MIN(roi), 6) AS worst_roi, ROUND(STDDEV_SAMP(roi), 6) AS spread FROM s GROUP BY 1""",
)
def season_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.season_stability(graded(spark, sf_dir), "profit", "season", ["market"], 100)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_roi", "worst_roi", "spread")})


EDGES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@query(
    "calibration_left_bins",
    f"""WITH {BETS_SQL}, b AS (SELECT CASE WHEN p = 1 THEN 5 WHEN p < 0.1 THEN 0 WHEN p < 0.25 THEN 1 WHEN p < 0.5 THEN 2 WHEN p < 0.75 THEN 3 WHEN p < 0.9 THEN 4 ELSE 5 END AS bin, p, y FROM graded)
    SELECT bin, COUNT(*) AS n, ROUND(AVG(p), 6) AS mean_p, ROUND(AVG(y), 6) AS rate, ROUND(ABS(AVG(p) - AVG(y)), 6) AS gap FROM b GROUP BY 1""",
)
def calibration_left_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.calibration(graded(spark, sf_dir), bins.left_closed(F.col("p"), EDGES), "p", "y")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_p", "rate", "gap")})


@query(
    "calibration_right_bins",
    f"""WITH {BETS_SQL}, b AS (SELECT market, CASE WHEN p <= 0 THEN NULL WHEN p <= 0.1 THEN 0 WHEN p <= 0.25 THEN 1 WHEN p <= 0.5 THEN 2 WHEN p <= 0.75 THEN 3 WHEN p <= 0.9 THEN 4 WHEN p <= 1 THEN 5 END AS bin, p, y FROM graded)
    SELECT market, bin, COUNT(*) AS n, ROUND(AVG(p), 6) AS mean_p, ROUND(AVG(y), 6) AS rate, ROUND(ABS(AVG(p) - AVG(y)), 6) AS gap FROM b WHERE bin IS NOT NULL GROUP BY 1, 2""",
)
def calibration_right_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.calibration(graded(spark, sf_dir), bins.right_closed(F.col("p"), EDGES), "p", "y", ["market"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_p", "rate", "gap")})


@query(
    "brier_decomposition",
    f"""WITH {BETS_SQL}, b AS (SELECT FLOOR(p * 10) AS bin, COUNT(*) AS n, AVG(p) AS mp, AVG(y) AS my FROM graded GROUP BY 1), t AS (SELECT COUNT(*) AS a, AVG(y) AS base FROM graded)
    SELECT ROUND(SUM(n * (mp - my) ** 2) / MAX(a), 8) AS reliability, ROUND(SUM(n * (my - base) ** 2) / MAX(a), 8) AS resolution, ROUND(MAX(base) * (1 - MAX(base)), 8) AS uncertainty FROM b, t""",
)
def brier_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.brier_parts(graded(spark, sf_dir), F.floor(F.col("p") * 10), "p", "y")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query(
    "confusion_metrics",
    f"""WITH {BETS_SQL}, c AS (SELECT market, COUNT(*) FILTER (WHERE p >= 0.5 AND won) AS tp, COUNT(*) FILTER (WHERE p >= 0.5 AND NOT won) AS fp, COUNT(*) FILTER (WHERE p < 0.5 AND NOT won) AS tn, COUNT(*) FILTER (WHERE p < 0.5 AND won) AS fn FROM graded GROUP BY 1)
    SELECT *, ROUND(tp / (tp + fp)::DOUBLE, 6) AS precision, ROUND(tp / (tp + fn)::DOUBLE, 6) AS recall, ROUND(tn / (tn + fp)::DOUBLE, 6) AS specificity, ROUND((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, ROUND(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""",
)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.confusion(graded(spark, sf_dir), F.col("p") >= 0.5, F.col("won"), ["market"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "specificity", "accuracy", "f1")})


@query(
    "roc_auc_exact",
    f"""WITH {BETS_SQL}, r AS (SELECT market, y, RANK() OVER (PARTITION BY market ORDER BY p) + (COUNT(*) OVER (PARTITION BY market, p) - 1) / 2.0 AS rk FROM graded)
    SELECT market, ROUND((SUM(rk) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * (COUNT(*) - SUM(y))), 8) AS auc FROM r GROUP BY 1""",
)
def roc_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.auc(graded(spark, sf_dir), "p", "y", ["market"]).withColumn("auc", F.round("auc", 8))


@query(
    "consensus_median",
    """WITH b AS (SELECT l_orderkey, l_suppkey, AVG(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS a, AVG(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS r FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, ROUND(MEDIAN(a), 6) AS "A_median", ROUND(MEDIAN(r), 6) AS "R_median", COUNT(*) AS books FROM b GROUP BY 1""",
)
def consensus_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.consensus(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "R"], "l_discount", "l_suppkey")
    return out.withColumns({c: F.round(c, 6) for c in ("A_median", "R_median")})


@query(
    "line_stats",
    """SELECT l_partkey, ROUND(AVG(l_discount), 6) AS mean, MIN(l_discount) AS low, MAX(l_discount) AS high, ROUND(STDDEV_SAMP(l_discount), 6) AS spread, COUNT(DISTINCT l_suppkey) AS books, COUNT(*) AS lines FROM lineitem GROUP BY 1""",
)
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_discount"), 6).alias("mean"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"),
        F.round(F.stddev_samp("l_discount"), 6).alias("spread"), F.countDistinct("l_suppkey").alias("books"), F.count(F.lit(1)).alias("lines"),
    )


@query(
    "error_metrics",
    """SELECT l_returnflag, COUNT(*) AS n, ROUND(AVG(ABS(l_quantity - l_extendedprice / 2000)), 6) AS mae, ROUND(SQRT(AVG((l_quantity - l_extendedprice / 2000) ** 2)), 6) AS rmse,
      ROUND(AVG(l_quantity - l_extendedprice / 2000), 6) AS bias, ROUND(CORR(l_quantity, l_extendedprice / 2000), 6) AS corr FROM lineitem GROUP BY 1""",
)
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*agg.error_metrics(F.col("l_quantity"), F.col("l_extendedprice") / 2000))
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "bias", "corr")})


@query(
    "mcnemar",
    f"""WITH {BETS_SQL}, c AS (SELECT COUNT(*) FILTER (WHERE (p >= 0.5) = won AND (odds < 0) <> won) AS only_a, COUNT(*) FILTER (WHERE (p >= 0.5) <> won AND (odds < 0) = won) AS only_b FROM graded)
    SELECT only_a, only_b, ROUND(GREATEST(0, ABS(only_a - only_b) - 1) ** 2 / (only_a + only_b)::DOUBLE, 6) AS statistic FROM c""",
)
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mcnemar(graded(spark, sf_dir), F.col("p") >= 0.5, F.col("odds") < 0, F.col("won")).withColumn("statistic", F.round("statistic", 6))


@query(
    "prior_rate",
    f"""WITH {BETS_SQL}, s AS (SELECT market, season, SUM(y) AS a, COUNT(*) AS c FROM graded GROUP BY 1, 2),
    r AS (SELECT market, season, SUM(a) OVER w AS a, COALESCE(SUM(c) OVER w, 0) AS c FROM s WINDOW w AS (PARTITION BY market ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(r.a / r.c::DOUBLE, 8) AS base, r.c::BIGINT AS base_n FROM graded JOIN r USING (market, season)""",
)
def prior_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = walkforward.prior_rate(graded(spark, sf_dir), ["market"], "season", "y", "base")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("base", 8).alias("base"), "base_n")


@query(
    "residual_cdf",
    f"""WITH {BETS_SQL}, x AS (SELECT *, p * 60 - 20 AS point FROM graded), d AS (SELECT DISTINCT market, season, point FROM x),
    h AS (SELECT d.market, d.season, d.point, COUNT(*) FILTER (WHERE g.residual > d.point) AS hits, COUNT(g.residual) AS n FROM d LEFT JOIN graded g ON g.market = d.market AND g.season < d.season GROUP BY 1, 2, 3)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND((hits + 10.0) / (n + 20.0), 8) AS over_p, n AS over_p_n FROM x JOIN h USING (market, season, point)""",
)
def residual_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = graded(spark, sf_dir).withColumn("point", F.col("p") * 60 - 20).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "market", "season", "residual", "point")
    out = walkforward.residual_cdf(bets, ["market"], "season", "residual", "point", "over_p")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("over_p", 8).alias("over_p"), "over_p_n")


@query(
    "blend_weight",
    f"""WITH {BETS_SQL}, m AS (SELECT *, CASE WHEN odds > 0 THEN 100 / (odds + 100) ELSE ABS(odds) / (ABS(odds) + 100) END AS mp FROM graded),
    s AS (SELECT market, season, SUM((p - y) ** 2) AS a, SUM((mp - y) ** 2) AS b FROM m GROUP BY 1, 2),
    w AS (SELECT market, season, GREATEST(0, LEAST(1, 0.5 + 2 * COALESCE((SUM(b) OVER w - SUM(a) OVER w) / SUM(b) OVER w, 0))) AS weight FROM s WINDOW w AS (PARTITION BY market ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(weight, 6) AS weight, ROUND(weight * p + (1 - weight) * mp, 6) AS blended FROM m JOIN w USING (market, season)""",
)
def blend_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = graded(spark, sf_dir).withColumn("mp", odds.american_to_implied(F.col("odds")))
    out = walkforward.blend_weight(bets, ["market"], "season", "p", "mp", "y")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("weight", 6).alias("weight"), F.round("blended", 6).alias("blended"))


@query(
    "empirical_backoff",
    f"""WITH {BETS_SQL}, t AS (SELECT * FROM graded WHERE season < 2000), s AS (SELECT * FROM graded WHERE season = 2000),
    a AS (SELECT segment, week, AVG(y) AS r FROM t GROUP BY 1, 2 HAVING COUNT(*) >= 800), b AS (SELECT week, AVG(y) AS r FROM t GROUP BY 1 HAVING COUNT(*) >= 800), c AS (SELECT AVG(y) AS r FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(COALESCE(a.r, b.r, c.r), 8) AS rate FROM s LEFT JOIN a USING (segment, week) LEFT JOIN b USING (week), c""",
)
def empirical_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, score = walkforward.split(graded(spark, sf_dir), "season", 2000)
    out = walkforward.backoff_rate(train, score, [["segment", "week"], ["week"], []], "y", 800, "rate")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("rate", 8).alias("rate"))


@query(
    "platt_calibration",
    f"""WITH RECURSIVE {BETS_SQL}, t AS (SELECT LN(p / (1 - p)) AS z, COUNT(*) AS n, SUM(y) AS s FROM graded WHERE season < 2000 GROUP BY p),
    it(i, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
      SELECT i, a, b, SUM(s - n * q) - 1e-6 * a AS g0, SUM((s - n * q) * z) - 1e-6 * b AS g1, SUM(n * q * (1 - q)) + 1e-6 AS h00, SUM(n * q * (1 - q) * z) AS h01, SUM(n * q * (1 - q) * z * z) + 1e-6 AS h11
      FROM (SELECT i, a, b, z, n, s, 1 / (1 + EXP(-(a + z * b))) AS q FROM it, t) GROUP BY i, a, b) WHERE i < 12),
    f AS (SELECT a, b FROM it WHERE i = 12)
    SELECT l_orderkey, l_linenumber, ROUND(1 / (1 + EXP(-(LN(p / (1 - p)) * b + a))), 6) AS calibrated FROM graded, f WHERE season >= 2000""",
)
def platt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = graded(spark, sf_dir).withColumn("z", odds.logit(F.col("p")))
    a, b = walkforward.platt(bets.filter("season < 2000"), "z", "y")
    return bets.filter("season >= 2000").select("l_orderkey", "l_linenumber", F.round(odds.sigmoid(F.col("z") * b + a), 6).alias("calibrated"))
