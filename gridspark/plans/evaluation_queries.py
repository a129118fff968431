"""Choice of a calibration layer, bootstrap of ROC areas and walk-forward scores, on bets and games made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import aggregates, calibrate, walkforward
from gridspark.plans.aggregate_queries import BETS_SQL, graded
from gridspark.plans.registry import query, table


@query(
    "calibration_selection",
    f"""WITH RECURSIVE {BETS_SQL}, k AS (SELECT season, p, SUM(y)::DOUBLE AS s, COUNT(*)::DOUBLE AS c FROM graded GROUP BY 1, 2),
    t AS (SELECT season, p, SUM(s) AS s, SUM(c) AS c FROM (SELECT unnest(range(season + 1, season + 4)) AS season, p, s, c FROM k) GROUP BY 1, 2),
    ok AS (SELECT season, SUM(c * p) / SUM(c) AS mu FROM t WHERE season IN (SELECT season FROM k) GROUP BY 1 HAVING SUM(c) >= 150 AND SUM(s) > 0 AND SUM(s) < SUM(c)),
    z AS (SELECT season, p, s, c, mu, SQRT(SUM(c * (p - mu) ** 2) OVER (PARTITION BY season) / SUM(c) OVER (PARTITION BY season)) AS sd FROM t JOIN ok USING (season)),
    it(season, i, a, b) AS (SELECT season, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM ok UNION ALL
      SELECT season, i + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
        SELECT season, i, a, b, SUM(c * q - s) AS g0, SUM((c * q - s) * x) + b AS g1, SUM(c * q * (1 - q)) AS h00, SUM(c * q * (1 - q) * x) AS h01, SUM(c * q * (1 - q) * x * x) + 1 AS h11
        FROM (SELECT it.season, i, a, b, c, s, (p - mu) / sd AS x, 1 / (1 + EXP(-(a + b * (p - mu) / sd))) AS q FROM it JOIN z ON z.season = it.season) GROUP BY season, i, a, b) WHERE i < 12),
    n AS (SELECT season, p, s, c, ROW_NUMBER() OVER w AS i, SUM(s) OVER w AS cs, SUM(c) OVER w AS cc FROM z WINDOW w AS (PARTITION BY season ORDER BY p)),
    m AS (SELECT a.season, a.i AS lo, b.i AS hi, (b.cs - a.cs + a.s) / (b.cc - a.cc + a.c) AS m FROM n a JOIN n b ON a.season = b.season AND a.i <= b.i),
    l AS (SELECT season, hi, MIN(m) OVER (PARTITION BY season, lo ORDER BY hi DESC) AS least FROM m),
    iso AS (SELECT season, hi AS i, MAX(least) AS level FROM l GROUP BY 1, 2), pts AS (SELECT n.season, n.p, level FROM n JOIN iso USING (season, i)),
    e AS (SELECT k.season, k.p, k.s, k.c, MAX(u.p) FILTER (WHERE u.p <= k.p) AS pl, MIN(u.p) FILTER (WHERE u.p >= k.p) AS pu FROM k JOIN pts u ON u.season = k.season GROUP BY ALL),
    f AS (SELECT e.*, x.level AS ll, y.level AS lu, 1 / (1 + EXP(-(a + b * (e.p - z.mu) / z.sd))) AS sig FROM e LEFT JOIN pts x ON x.season = e.season AND x.p = pl LEFT JOIN pts y ON y.season = e.season AND y.p = pu
      JOIN it ON it.season = e.season AND it.i = 12 JOIN (SELECT DISTINCT season, mu, sd FROM z) z ON z.season = e.season),
    g AS (SELECT season, s, c, unnest(['none', 'sigmoid', 'isotonic']) AS method, unnest([1, 2, 3]) AS o, unnest([p, sig, CASE WHEN pl IS NULL THEN lu WHEN pu IS NULL OR pl = pu THEN ll ELSE ll + (lu - ll) * (p - pl) / (pu - pl) END]) AS q0 FROM f),
    h AS (SELECT *, GREATEST(1e-6, LEAST(1 - 1e-6, q0)) AS q FROM g),
    r AS (SELECT method, o, SUM(s * (1 - q) ** 2 + (c - s) * q ** 2) / SUM(c) AS brier, SUM(-s * LN(q) - (c - s) * LN(1 - q)) / SUM(c) AS log_loss, SUM(c)::BIGINT AS n_games, COUNT(DISTINCT season) AS n_seasons FROM h GROUP BY 1, 2),
    v AS (SELECT *, MAX(brier) FILTER (WHERE o = 1) OVER () AS plain, MIN(brier) OVER () AS least FROM r)
    SELECT method, ROUND(brier, 7) AS brier, ROUND(log_loss, 7) AS log_loss, n_games, n_seasons, CASE WHEN plain - least >= 0.0005 THEN brier = least ELSE o = 1 END AS selected FROM v""",
)
def calibration_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which layer beats the raw probabilities of the bets on seasons it has not seen."""
    out = calibrate.select_calibration(graded(spark, sf_dir), "p", "y", "season", 3)
    return out.withColumns({"brier": F.round("brier", 7), "log_loss": F.round("log_loss", 7)})


@query("bootstrap_auc_gap")
def bootstrap_auc_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bets' probabilities against the prices' implied ones. Weights come from Spark's own hash; tested against a plain bootstrap."""
    bets = graded(spark, sf_dir).withColumn("implied", F.when(F.col("odds") > 0, 100 / (F.col("odds") + 100)).otherwise(-F.col("odds") / (100 - F.col("odds"))))
    return aggregates.bootstrap_auc(bets, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "p", "implied", "y", 200)


def _cdf(z: str) -> str:
    """The library's normal distribution in SQL."""
    x = f"(ABS({z}) / SQRT(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    half = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * EXP(-{x} * {x}) / 2)"
    return f"CASE WHEN {z} >= 0 THEN 1 - {half} ELSE {half} END"


WALK_SQL = """g AS (SELECT o_orderkey AS game_id, YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey % 29 - 14 + (o_custkey % 17 - 8) * 0.5)::DOUBLE END AS margin,
    CASE WHEN o_custkey % 23 > 0 THEN (o_custkey % 17 - 8)::DOUBLE END AS x FROM orders), f AS (SELECT *, COALESCE(x, 0) AS v FROM g WHERE margin IS NOT NULL),
  w AS (SELECT season, week, SUM(CASE WHEN season >= 1996 THEN 1.0 ELSE 0 END)::DOUBLE AS n, SUM(CASE WHEN season >= 1996 THEN v ELSE 0 END) AS sx, SUM(CASE WHEN season >= 1996 THEN v * v ELSE 0 END) AS sxx, SUM(CASE WHEN season >= 1996 THEN margin ELSE 0 END) AS sy,
    SUM(CASE WHEN season >= 1996 THEN v * margin ELSE 0 END) AS sxy, SUM(CASE WHEN season >= 1996 THEN margin * margin ELSE 0 END) AS yy, SUM(CASE WHEN season >= 1996 AND margin > 0 THEN 1 ELSE 0 END) AS won,
    SUM(CASE WHEN season >= 1996 AND margin < 0 THEN 1 ELSE 0 END) AS lost FROM f GROUP BY 1, 2)"""


def _walk_sql(frame: str, refit: str) -> str:
    sums = ", ".join(f"SUM({c}) OVER b AS {c}" for c in ("n", "sx", "sxx", "sy", "sxy", "yy", "won", "lost"))
    return f"""WITH {WALK_SQL}, r AS (SELECT season, week, {refit}::INT AS refit_id, {sums}, MIN(CASE WHEN n > 0 THEN season END) OVER b AS train_start, MAX(CASE WHEN n > 0 THEN season END) OVER b AS train_end FROM w WINDOW b AS ({frame})),
    m AS (SELECT *, (n * sxy - sx * sy) / (n * (sxx + 1) - sx * sx) AS b1 FROM r WHERE n >= 150 AND won > 0 AND lost > 0), c AS (SELECT *, (sy - sx * b1) / n AS b0 FROM m),
    d AS (SELECT *, SQRT((yy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx) / n) AS spread FROM c),
    e AS (SELECT game_id, f.season, f.week, refit_id, train_start::INT AS train_start, train_end::INT AS train_end, n::BIGINT AS train_rows, b0 + b1 * v AS z, spread FROM f JOIN d USING (season, week))
    SELECT game_id, season, week, refit_id, train_start, train_end, train_rows, ROUND(z, 7) AS pred_margin, ROUND({_cdf('(z / spread)')}, 7) AS win_prob FROM e"""


def _walk(spark: SparkSession, sf_dir: str, cadence: str) -> DataFrame:
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    games = table(spark, sf_dir, "orders").select(
        key.alias("game_id"), F.year("o_orderdate").cast("bigint").alias("season"), F.month("o_orderdate").cast("bigint").alias("week"),
        F.when(F.col("o_orderstatus") != "O", (key % 29 - 14 + (cust % 17 - 8) * 0.5).cast("double")).alias("margin"),
        F.when(cust % 23 > 0, (cust % 17 - 8).cast("double")).alias("x"),
    )
    out = walkforward.walk_forward_scores(games, ["x"], "margin", cadence, 1996)
    return out.drop("margin", "x").withColumns({"pred_margin": F.round("pred_margin", 7), "win_prob": F.round("win_prob", 7)})


@query("walk_forward_weekly", _walk_sql("ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROW_NUMBER() OVER (PARTITION BY season ORDER BY week) - 1"))
def walk_forward_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every week scored by a model of all final games before it."""
    return _walk(spark, sf_dir, "week")


@query("walk_forward_seasonal", _walk_sql("ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "0"))
def walk_forward_seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, "season")
