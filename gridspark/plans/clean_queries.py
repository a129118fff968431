"""Identity, incremental maintenance, quality reports and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import clean, quality, reshape
from gridspark.plans.registry import query, table
from gridspark.sources import io


@query("scan_filter_period", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'")
def scan_filter_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").filter(early).select("o_orderkey", "o_totalprice")


@query(
    "dedupe_keep_last",
    """SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
)
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return clean.keep_one(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], order).select("o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "priority_coalesce",
    """SELECT user_id, FIRST(value ORDER BY rank) FILTER (WHERE value > 20) AS amount, FIRST(event_id ORDER BY rank) FILTER (WHERE event_id % 3 = 0) AS pick
    FROM (SELECT user_id, value, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS rank FROM events) GROUP BY user_id""",
)
def priority_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = table(spark, sf_dir, "events").select(
        "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_type", "event_id")).alias("rank"),
        F.when(F.col("value") > 20, F.col("value")).alias("amount"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("pick"),
    )
    return clean.priority_coalesce(ranked, ["user_id"], "rank", ["amount", "pick"])


@query(
    "append_new_rows",
    """SELECT o_orderkey, o_orderstatus, NULL::VARCHAR AS note FROM orders WHERE o_orderstatus <> 'O'
    UNION ALL SELECT o_orderkey, NULL, 'new' FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus = 'O'""",
)
def append_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = orders.filter("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus")
    return clean.append_new(old, orders.filter("o_orderdate >= TIMESTAMP_NTZ '1996-01-01'").select("o_orderkey", F.lit("new").alias("note")), ["o_orderkey"])


@query(
    "replace_partitions",
    """SELECT o_orderkey, YEAR(o_orderdate) AS season, CAST(0 AS BIGINT) AS version FROM orders WHERE YEAR(o_orderdate) < 1999
    UNION ALL SELECT o_orderkey, YEAR(o_orderdate), 1 FROM orders WHERE YEAR(o_orderdate) >= 1999 AND o_orderstatus = 'F'""",
)
def replace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("season"), "o_orderstatus")
    new = rows.filter("season >= 1999 AND o_orderstatus = 'F'").drop("o_orderstatus").withColumn("version", F.lit(1).cast("bigint"))
    return clean.replace_partitions(rows.drop("o_orderstatus").withColumn("version", F.lit(0).cast("bigint")), new, "season")


@query(
    "snapshot_diff",
    """WITH a AS (SELECT p_partkey, p_brand, p_type FROM part), b AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'X' ELSE p_brand END AS p_brand,
      CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_size < 45)
    SELECT p_partkey, name, before, after FROM (
      SELECT COALESCE(a.p_partkey, b.p_partkey) AS p_partkey, 'p_brand' AS name, a.p_brand AS before, b.p_brand AS after FROM a FULL JOIN b ON a.p_partkey = b.p_partkey
      UNION ALL SELECT COALESCE(a.p_partkey, b.p_partkey), 'p_type', a.p_type, b.p_type FROM a FULL JOIN b ON a.p_partkey = b.p_partkey) WHERE before IS DISTINCT FROM after""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    new = table(spark, sf_dir, "part").filter("p_size < 45").select(
        "p_partkey", F.when(F.col("p_partkey") % 10 == 0, "X").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_partkey") % 15 != 0, F.col("p_type")).alias("p_type"),
    )
    return clean.snapshot_diff(old, new, ["p_partkey"], ["p_brand", "p_type"])


@query("key_collisions", "SELECT p_type AS key, COUNT(DISTINCT p_brand) AS n_values FROM part GROUP BY 1 HAVING COUNT(DISTINCT p_brand) > 1")
def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.collisions(table(spark, sf_dir, "part"), F.col("p_type"), "p_brand")


@query(
    "content_hash",
    """WITH o AS (SELECT CASE WHEN o_custkey % 7 > 0 THEN CAST(ROUND(o_totalprice * 100) AS BIGINT) END AS cents, o_orderdate::DATE AS day, o_orderkey AS key, o_orderstatus AS status FROM orders),
    r AS (SELECT md5(concat('cents:bigint', chr(31), (cents IS NULL)::VARCHAR, chr(31), COALESCE(cents::VARCHAR, ''), chr(31), 'day:date', chr(31), 'false', chr(31), day::VARCHAR, chr(31), 'key:bigint', chr(31), 'false', chr(31), key::VARCHAR, chr(31), 'status:string', chr(31), 'false', chr(31), status)) AS d FROM o)
    SELECT COUNT(*) AS rows, SUM(('0x' || substr(d, 1, 15))::BIGINT::HUGEINT)::VARCHAR AS hash FROM r""",
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.when(F.col("o_custkey") % 7 > 0, F.round(F.col("o_totalprice") * 100).cast("bigint"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"), cents.alias("cents"), F.col("o_orderdate").cast("date").alias("day"))
    return clean.content_hash(rows)


@query(
    "union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("semi_completed", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000)")
def semi_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(
    "topk_stable",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
)
def topk_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest lines: the limit is the feature."""
    return table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "best_row_per_key",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_discount, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n = 1""",
)
def best_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.asc("l_discount"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return clean.keep_one(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "completeness",
    """SELECT 'value' AS "column", COUNT(CASE WHEN value > 5 THEN 1 END) / COUNT(*)::DOUBLE AS fill_rate, COUNT(CASE WHEN value > 5 THEN 1 END) / COUNT(*)::DOUBLE >= 0.95 AS ok FROM events
    UNION ALL SELECT 'user_id', COUNT(user_id) / COUNT(*)::DOUBLE, COUNT(user_id) / COUNT(*)::DOUBLE >= 0.95 FROM events""",
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") > 5, F.col("value")))
    return quality.completeness(events, ["value", "user_id"])


@query(
    "feature_report",
    """SELECT 'l_quantity' AS "column", 0.0::DOUBLE AS null_rate, ROUND(VAR_SAMP(l_quantity), 4) AS variance, MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem
    UNION ALL SELECT 'l_tax', 0.0, ROUND(VAR_SAMP(l_tax), 4), MIN(l_tax), MAX(l_tax) FROM lineitem""",
)
def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.feature_report(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]).withColumn("variance", F.round("variance", 4))


@query(
    "outliers",
    "SELECT o_orderkey, o_totalprice FROM orders, (SELECT AVG(o_totalprice) AS m, STDDEV_SAMP(o_totalprice) AS s FROM orders) WHERE ABS(o_totalprice - m) > 1.6 * s",
)
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outliers(table(spark, sf_dir, "orders"), "o_totalprice", 1.6).select("o_orderkey", "o_totalprice")


@query(
    "freshness",
    "SELECT MAX(o_orderdate)::DATE AS latest, DATE_DIFF('day', MAX(o_orderdate)::DATE, DATE '2001-09-01') AS age_days, DATE_DIFF('day', MAX(o_orderdate)::DATE, DATE '2001-09-01') <= 60 AS fresh FROM orders",
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return quality.freshness(orders, "d", F.lit("2001-09-01").cast("date"), 60).withColumn("age_days", F.col("age_days").cast("bigint"))


@query(
    "validation_report",
    """SELECT 'price' AS "check", COUNT(*) FILTER (WHERE NOT o_totalprice > 10000) AS failures FROM orders
    UNION ALL SELECT 'status', COUNT(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders""",
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate(table(spark, sf_dir, "orders"), {"price": F.col("o_totalprice") > 10000, "status": F.col("o_orderstatus").isin("F", "O")})


@query(
    "unpivot_features",
    """SELECT p_partkey, name, value FROM (SELECT p_partkey, 'p_size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part)""",
)
def unpivot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return reshape.unpivot(part, ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    "complete_grid",
    """WITH n AS (SELECT DISTINCT user_id FROM events), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
    c AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS hits FROM events GROUP BY 1, 2)
    SELECT user_id, day, COALESCE(hits, 0) AS hits FROM n CROSS JOIN d LEFT JOIN c USING (user_id, day)""",
)
def complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    hits = events.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("hits"))
    return reshape.complete_grid(hits, events.select("user_id").distinct(), events.select("day").distinct(), ["user_id", "day"], {"hits": 0})


@query(
    "nested_odds_flatten",
    """SELECT p_partkey::VARCHAR AS id, 'A' AS home_team, p_brand AS away_team, b.book AS book, 'h2h' AS market, o.outcome AS outcome, p_size + o.k AS price, b.k * 1.0::DOUBLE AS point
    FROM part, (VALUES ('dk', 1), ('fd', 2)) AS b(book, k), (VALUES ('home', 0.5), ('away', 1.5)) AS o(outcome, k)""",
)
def nested_odds_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with bookmakers, markets and outcomes, written as JSON text and read back flat."""
    outcome = lambda n, k, b: F.struct(F.lit(n).alias("name"), (F.col("p_size") + k).alias("price"), F.lit(float(b)).alias("point"))
    book = lambda n, b: F.struct(F.lit(n).alias("key"), F.array(F.struct(F.lit("h2h").alias("key"), F.array(outcome("home", 0.5, b), outcome("away", 1.5, b)).alias("outcomes"))).alias("markets"))
    event = F.struct(F.col("p_partkey").cast("string").alias("id"), F.lit("A").alias("home_team"), F.col("p_brand").alias("away_team"), F.array(book("dk", 1), book("fd", 2)).alias("bookmakers"))
    return io.flatten_odds(table(spark, sf_dir, "part").select(F.to_json(event).alias("payload")), "payload")
