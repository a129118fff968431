"""Joins: sides, intervals, as-of, nearest, cascades, tiers, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import text
from gridspark.operators import joins, reshape
from gridspark.plans.registry import query, table


@query(
    "sides_unpivot",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'over' AS side, l_discount AS price, l_quantity > 25 AS won FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'under', l_tax, NOT l_quantity > 25 FROM lineitem""",
)
def sides_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("o", F.col("l_quantity") > 25).withColumn("u", ~F.col("o"))
    return reshape.sides(lines, {"price": "l_discount", "won": "o"}, {"price": "l_tax", "won": "u"}, ("over", "under"), ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "home_away_diffs",
    """WITH s AS (SELECT o_custkey AS k, YEAR(o_orderdate) AS season, SUM(o_totalprice) AS total, COUNT(*) AS games FROM orders GROUP BY 1, 2),
    g AS (SELECT o_orderkey, o_custkey AS home, (o_custkey * 7 + 3) % 1000 AS away, YEAR(o_orderdate) AS season FROM orders)
    SELECT o_orderkey, ROUND(h.total - a.total, 2) AS total_diff, h.games - a.games AS games_diff
    FROM g LEFT JOIN s h ON h.k = home AND h.season = g.season LEFT JOIN s a ON a.k = away AND a.season = g.season""",
)
def home_away_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate"))
    stats = orders.groupBy(F.col("o_custkey").alias("k"), "season").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("games"))
    games = orders.select("o_orderkey", F.col("o_custkey").alias("home"), ((F.col("o_custkey") * 7 + 3) % 1000).alias("away"), "season")
    return joins.home_away(games, stats, "home", "away", "k", ["season"], ["total", "games"]).select("o_orderkey", F.round("total_diff", 2).alias("total_diff"), "games_diff")


@query(
    "auto_diffs",
    """SELECT l_orderkey, l_linenumber, l_partkey, ROUND(l_discount - l_tax, 4) AS rate_diff, l_quantity - l_linenumber AS size_diff FROM lineitem""",
)
def auto_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("rate_home"), F.col("l_tax").alias("rate_away"), F.col("l_quantity").alias("size_home"),
        F.col("l_linenumber").cast("double").alias("size_away"), F.col("l_returnflag").alias("flag_home"), F.col("l_linestatus").alias("flag_away"),
    )
    return reshape.auto_diffs(named).select("l_orderkey", "l_linenumber", "l_partkey", F.round("rate_diff", 4).alias("rate_diff"), "size_diff")


@query(
    "opponent_adjusted",
    """WITH t AS (SELECT o_custkey AS team, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, AVG(o_totalprice) AS own FROM orders GROUP BY 1, 2),
    p AS (SELECT *, (team + 1) % 1500 AS opp, LAG(own) OVER (PARTITION BY team ORDER BY period) AS prev FROM t)
    SELECT a.team, a.period, ROUND(a.own - b.prev, 3) AS adjusted FROM p a LEFT JOIN p b ON b.team = a.opp AND b.period = a.period""",
)
def opponent_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridspark.operators.windows import ordered

    month = F.date_trunc("month", "o_orderdate").cast("date")
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("team"), month.alias("period")).agg(F.avg("o_totalprice").alias("own"))
    p = t.withColumn("opp", (F.col("team") + 1) % 1500).withColumn("prev", F.lag("own").over(ordered(["team"], ["period"])))
    b = p.select(F.col("team").alias("opp"), "period", F.col("prev").alias("opp_prev"))
    return p.join(b, ["opp", "period"], "left").select("team", "period", F.round(F.col("own") - F.col("opp_prev"), 3).alias("adjusted"))


@query(
    "full_outer_sources",
    """WITH a AS (SELECT l_suppkey AS k, SUM(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09 GROUP BY 1), b AS (SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier WHERE s_acctbal > 0)
    SELECT COALESCE(a.k, b.k) AS k, q, bal, COALESCE(q, bal) AS first_known FROM a FULL JOIN b ON a.k = b.k""",
)
def full_outer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_discount > 0.09").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("q"))
    b = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return a.join(b, "k", "full").withColumn("first_known", F.coalesce("q", "bal"))


@query(
    "interval_join_7d",
    """SELECT a.event_id, COUNT(b.event_id) AS n_recent, MIN(DATE_DIFF('second', b.ts, a.ts)) AS seconds FROM events a
    JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup' AND FLOOR(EPOCH(b.ts)) BETWEEN FLOOR(EPOCH(a.ts)) - 604800 AND FLOOR(EPOCH(a.ts))
    WHERE a.event_type = 'purchase' GROUP BY 1""",
)
def interval_join_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    news = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("seen"))
    met = joins.interval_join(bought, news, ["user_id"], "ts", "seen", "days", 7)
    return met.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_recent"), F.min(F.round(F.col("days") * 86_400).cast("bigint")).alias("seconds"))


@query(
    "asof_latest",
    """SELECT a.event_id, b.ts AS seen_asof, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    seen = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("last_value"))
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_join(bought, seen, "user_id", "ts", "seen", ["last_value"]).select("event_id", "seen_asof", "last_value")


@query(
    "nearest_event",
    """SELECT event_id, near_id FROM (SELECT a.event_id, b.event_id AS near_id, ROW_NUMBER() OVER (PARTITION BY a.event_id ORDER BY ABS(EPOCH_US(a.ts) - EPOCH_US(b.ts)), b.event_id) AS n
      FROM events a JOIN events b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) WHERE a.event_type = 'error' AND b.event_type = 'click') WHERE n = 1""",
)
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    bad = events.filter("event_type = 'error'").select("event_id", "user_id", "day", "ts")
    near = events.filter("event_type = 'click'").select("user_id", "day", F.col("event_id").alias("near_id"), F.col("ts").alias("near_ts"))
    return joins.nearest(bad, near, ["user_id", "day"], "ts", "near_ts", ["near_id"], ["near_id"]).select("event_id", "near_id")


@query(
    "cascade_join",
    """WITH r AS (SELECT *, CASE WHEN p_size > 10 THEN p_retailprice END AS v, CASE WHEN p_size < 40 THEN p_name END AS n FROM part),
    l AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
    k1 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY p_partkey) AS i FROM r) WHERE i = 1),
    k2 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS i FROM r) WHERE i = 1),
    k3 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM r) WHERE i = 1)
    SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(k1.v, k2.v, k3.v) AS price, COALESCE(k1.n, k2.n, k3.n) AS name,
      CASE WHEN k1.v IS NOT NULL OR k1.n IS NOT NULL THEN 1 WHEN k2.v IS NOT NULL OR k2.n IS NOT NULL THEN 2 WHEN k3.v IS NOT NULL OR k3.n IS NOT NULL THEN 3 END AS level
    FROM l LEFT JOIN k1 ON l.l_partkey = k1.p_partkey LEFT JOIN k2 ON l.p_brand = k2.p_brand AND l.p_type = k2.p_type LEFT JOIN k3 ON l.p_brand = k3.p_brand""",
)
def cascade_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices known for larger parts and names for smaller ones: what a part lacks comes from its brand and type, then from its brand."""
    part = table(spark, sf_dir, "part")
    left = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_partkey", "p_brand", "p_type")
    right = part.select(
        "p_partkey", "p_brand", "p_type", F.col("p_partkey").alias("first"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price"),
        F.when(F.col("p_size") < 40, F.col("p_name")).alias("name"),
    )
    levels = [["p_partkey"], ["p_brand", "p_type"], ["p_brand"]]
    return joins.cascade_join(left, right, levels, ["price", "name"], ["first"]).select("l_orderkey", "l_linenumber", "l_partkey", "price", "name", "level")


@query(
    "tiered_match",
    """WITH r AS (SELECT c_custkey, c_nationkey, c_mktsegment, FLOOR(c_acctbal / 100) AS cell FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    l AS (SELECT c_custkey AS row, c_nationkey, c_mktsegment, FLOOR(c_acctbal / 100) AS cell FROM customer),
    a AS (SELECT c_nationkey, c_mktsegment, cell, MIN(c_custkey) AS v FROM r GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT c_custkey) = 1),
    b AS (SELECT c_nationkey, cell, MIN(c_custkey) AS v FROM r GROUP BY 1, 2 HAVING COUNT(DISTINCT c_custkey) = 1)
    SELECT row, COALESCE(a.v, b.v) AS matched, CASE WHEN a.v IS NOT NULL THEN 'strict' WHEN b.v IS NOT NULL THEN 'loose' END AS match_method
    FROM l LEFT JOIN a USING (c_nationkey, c_mktsegment, cell) LEFT JOIN b USING (c_nationkey, cell)""",
)
def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).alias("cell"))
    tiers = [("strict", ["c_nationkey", "c_mktsegment", "cell"]), ("loose", ["c_nationkey", "cell"])]
    right = people.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").withColumnRenamed("c_custkey", "matched")
    return joins.tiered_match(people.withColumnRenamed("c_custkey", "row"), right, "row", tiers, "matched").select("row", "matched", "match_method")


@query(
    "unique_name_lookup",
    """SELECT p_name || ' ' || p_brand AS key, MIN(p_type) AS p_type FROM part GROUP BY 1 HAVING COUNT(DISTINCT p_type) = 1""",
)
def unique_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.unique_lookup(table(spark, sf_dir, "part"), F.concat_ws(" ", "p_name", "p_brand"), "p_type")


@query(
    "gap_audit",
    """SELECT k, 'no order' AS reason FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT k, 'no supplier' FROM (SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer)""",
)
def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return joins.gap_audit(a, b, ["k"], "no order", "no supplier")


@query(
    "name_keys",
    """WITH n AS (SELECT s_suppkey, string_split(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ' ') AS p FROM supplier)
    SELECT s_suppkey, substring(p[1], 1, 1) || ':' || p[len(p)] AS initial_last, substring(p[1], 1, 2) || ':' || p[len(p)] AS prefix FROM n""",
)
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.initial_last_key(name).alias("initial_last"), text.prefix_key(name).alias("prefix"))
