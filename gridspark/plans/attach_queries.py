"""Attaching odds, policies, venues and files' own periods to games made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions import geo
from gridspark.operators import market
from gridspark.plans.aggregate_queries import BETS_SQL, graded
from gridspark.plans.registry import query, table
from gridspark.sources.scratch import folder
from gridspark.sources import feeds, io


@query(
    "wide_odds",
    """SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '2-HIGH') AS "odds_2-HIGH_price", arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderpriority = '2-HIGH') AS "odds_2-HIGH_status",
      arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW') AS "odds_5-LOW_price", arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW') AS "odds_5-LOW_status"
    FROM orders WHERE o_orderpriority IN ('2-HIGH', '5-LOW') GROUP BY 1""",
)
def wide_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("book"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return market.wide_odds(offers, "o_custkey", "book", ["2-HIGH", "5-LOW"], ["price", "status"], "o_orderkey")


@query(
    "defence_from_opponent",
    """WITH t AS (SELECT o_custkey AS team, YEAR(o_orderdate) AS season, COUNT(*) AS off, CASE WHEN COUNT(*) > 2 THEN COUNT(*) * 10 END AS def FROM orders GROUP BY 1, 2), u AS (SELECT *, team + 1 AS opp FROM t)
    SELECT a.team, a.season, COALESCE(a.def, b.off) AS def, CASE WHEN a.def IS NOT NULL THEN 'own' WHEN b.off IS NOT NULL THEN 'opponent' ELSE 'none' END AS def_source FROM u a LEFT JOIN u b ON b.team = a.opp AND b.season = a.season""",
)
def defence_from_opponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    teams = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("team"), F.year("o_orderdate").cast("bigint").alias("season")).agg(n.alias("off"), F.when(n > 2, n * 10).alias("def"))
    out = market.filled_from_opponent(teams.withColumn("opp", F.col("team") + 1), {"def": "off"}, "team", "opp", ["season"])
    return out.select("team", "season", "def", "def_source")


@query(
    "public_board",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'hidden' WHEN o_totalprice < 50000 THEN 'hidden' WHEN o_orderpriority LIKE '1%' THEN 'review' ELSE 'shown' END AS status,
      CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'ok' END AS reason FROM orders""",
)
def public_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("hidden", "pending", F.col("o_orderstatus") == "P"), ("hidden", "small", F.col("o_totalprice") < 50000), ("review", "urgent", F.startswith("o_orderpriority", F.lit("1")))]
    return market.board_status(table(spark, sf_dir, "orders"), rules, ("shown", "ok")).select("o_orderkey", "status", "reason")


@query(
    "market_policy",
    f"""WITH {BETS_SQL}, b AS (SELECT market, FLOOR(p / 0.1 + 0.000000001)::INT AS bin, COUNT(*) AS n, ROUND(AVG(y), 8) AS rate FROM graded WHERE season < 2000 GROUP BY 1, 2),
    w AS (SELECT bin, SUM(n) AS n, SUM(n * rate) / SUM(n) AS rate FROM b GROUP BY 1), s AS (SELECT *, FLOOR(p / 0.1 + 0.000000001)::INT AS bin FROM graded WHERE season >= 2000)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ROUND(COALESCE(b.rate, w.rate, p), 7) AS calibrated, CASE WHEN b.rate IS NOT NULL THEN 'segment' WHEN w.rate IS NOT NULL THEN 'overall' ELSE 'raw' END AS calibration_level
    FROM s LEFT JOIN b ON b.market = s.market AND b.bin = s.bin AND b.n >= 1500 LEFT JOIN w ON w.bin = s.bin AND w.n >= 1500""",
)
def market_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = graded(spark, sf_dir)
    cell = F.floor(F.col("p") / 0.1 + 1e-9).cast("int")
    bins = bets.filter("season < 2000").groupBy("market", cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 8).alias("rate"))
    out = market.attach_policy(bets.filter("season >= 2000"), bins, "market", "p", 0.1, 1500)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("calibrated", 7).alias("calibrated"), "calibration_level")


@query(
    "travel_context",
    """WITH v AS (SELECT n_nationkey AS team, 'v' || n_nationkey AS venue, n_nationkey * 3.0 - 30 AS lat, n_nationkey * 10.0 - 120 AS lon, (n_nationkey % 5)::INT - 8 AS off FROM nation),
    g AS (SELECT o_orderkey AS game_id, 'v' || (o_orderkey % 30) AS venue, (o_custkey % 25) AS home, (o_orderkey % 23) AS away FROM orders),
    j AS (SELECT game_id, p.lat AS a, p.lon AS b, p.off AS c, h.lat AS ha, h.lon AS hb, h.off AS hc, w.lat AS wa, w.lon AS wb, w.off AS wc FROM g LEFT JOIN v p ON p.venue = g.venue LEFT JOIN v h ON h.team = home LEFT JOIN v w ON w.team = away)
    SELECT game_id, ROUND(2 * 6371.0 * ASIN(SQRT(LEAST(1, SIN(RADIANS(a - ha) / 2) ** 2 + COS(RADIANS(ha)) * COS(RADIANS(a)) * SIN(RADIANS(b - hb) / 2) ** 2))), 4) AS home_km, ABS(hc - c) AS home_shift,
      ROUND(2 * 6371.0 * ASIN(SQRT(LEAST(1, SIN(RADIANS(a - wa) / 2) ** 2 + COS(RADIANS(wa)) * COS(RADIANS(a)) * SIN(RADIANS(b - wb) / 2) ** 2))), 4) AS away_km, ABS(wc - c) AS away_shift FROM j WHERE a IS NOT NULL
    UNION ALL SELECT game_id, NULL, NULL, NULL, NULL FROM j WHERE a IS NULL""",
)
def travel_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games at venues that nobody knows keep their row, without distances."""
    n = F.col("n_nationkey")
    venues = table(spark, sf_dir, "nation").select(
        n.cast("bigint").alias("team"), F.concat(F.lit("v"), n).alias("venue"), (n * 3.0 - 30).alias("lat"), (n * 10.0 - 120).alias("lon"), (n % 5 - 8).alias("offset")
    )
    games = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), F.concat(F.lit("v"), F.col("o_orderkey") % 30).alias("venue"), (F.col("o_custkey") % 25).alias("home"), (F.col("o_orderkey") % 23).alias("away"))
    out = market.travel(games, venues, "venue", geo.haversine_km)
    return out.select("game_id", F.round("home_km", 4).alias("home_km"), "home_shift", F.round("away_km", 4).alias("away_km"), "away_shift")


@query(
    "history_files",
    "SELECT o_orderkey, o_totalprice, YEAR(o_orderdate)::INT AS season, MONTH(o_orderdate)::INT AS week, YEAR(o_orderdate)::INT AS file_season, MONTH(o_orderdate)::INT AS file_week FROM orders",
)
def history_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder per season and week is written, then found again by its name."""
    path = folder(spark, "history")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"))
    io.write_partitions(rows, path, ["season", "week"])
    found = feeds.from_file_name(spark.read.parquet(path), r"season=(\d+)/week=(\d+)/", ["file_season", "file_week"])
    return found.select("o_orderkey", "o_totalprice", "season", "week", "file_season", "file_week")


@query(
    "reference_tables",
    "SELECT c_custkey, n_name AS venue, 'r' || n_regionkey AS roof, n_regionkey::DOUBLE / 2 AS advantage FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
)
def reference_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small typed CSV files attached by key; roofs are trimmed and lower-cased."""
    path = f"{folder(spark, 'reference')}/venues.csv"
    nation = table(spark, sf_dir, "nation")
    nation.select("n_nationkey", "n_name", F.concat(F.lit(" R"), "n_regionkey").alias("roof"), (F.col("n_regionkey") / 2).alias("advantage")).write.option("header", True).csv(path)
    kinds = T.StructType([T.StructField(n, t) for n, t in (("n_nationkey", T.LongType()), ("n_name", T.StringType()), ("roof", T.StringType()), ("advantage", T.DoubleType()))])
    venues = io.read_table(spark, path, schema=kinds).select("n_nationkey", F.col("n_name").alias("venue"), F.lower(F.trim("roof")).alias("roof"), "advantage")
    return table(spark, sf_dir, "customer").join(venues, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "venue", "roof", "advantage")
