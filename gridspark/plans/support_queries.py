"""Clocks, ids, units, reports on injuries and plain files, on the star schema's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions import bins, geo, ids, teams, text, time
from gridspark.operators import football, joins, quality, windows
from gridspark.plans.registry import query, table
from gridspark.sources import io
from gridspark.sources.scratch import folder

ZONE = "America/New_York"


@query(
    "kickoff_clock",
    f"""WITH g AS (SELECT o_orderkey AS game_id, o_orderdate::DATE AS day, CASE WHEN o_custkey % 5 > 0 THEN lpad((o_custkey % 24)::VARCHAR, 2, '0') || ':30' END AS clock FROM orders),
    t AS (SELECT *, try_strptime(day::VARCHAR || ' ' || COALESCE(clock, '13:00'), '%Y-%m-%d %H:%M') AS l FROM g), u AS (SELECT *, timezone('{ZONE}', l) AS z FROM t),
    w AS (SELECT *, timezone('{ZONE}', z) = l AND timezone('{ZONE}', z + INTERVAL 1 HOUR) <> l AND timezone('{ZONE}', z - INTERVAL 1 HOUR) <> l AS good FROM u)
    SELECT game_id, CASE WHEN good THEN timezone('UTC', z) END AS kickoff FROM w""",
)
def kickoff_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local days and clocks as instants; hours that a change of clocks skips or repeats are null."""
    cust = F.col("o_custkey")
    clock = F.when(cust % 5 > 0, F.concat(F.lpad((cust % 24).cast("string"), 2, "0"), F.lit(":30")))
    at = time.kickoff_utc(F.col("o_orderdate").cast("date"), clock, ZONE, "13:00")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), at.alias("kickoff"))


@query(
    "slate_phases",
    """WITH w AS (SELECT YEAR(o_orderdate) AS season, WEEKOFYEAR(o_orderdate) AS week, MIN(o_orderdate)::TIMESTAMP AS first, MAX(o_orderdate)::TIMESTAMP AS last, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS final, COUNT(*) AS games FROM orders GROUP BY 1, 2)
    SELECT season, week, CASE WHEN week <= 4 THEN 'early' WHEN week <= 9 THEN 'mid' WHEN week <= 14 THEN 'late' WHEN week <= 18 THEN 'closing' ELSE 'playoffs' END AS bucket,
      CASE WHEN final = games THEN 'complete' WHEN TIMESTAMP '1999-03-04' < first THEN 'upcoming' WHEN TIMESTAMP '1999-03-04' <= last THEN 'in_progress' ELSE 'awaiting_results' END AS phase,
      date_trunc('day', first) - INTERVAL 1 DAY * ((dayofweek(first) - 3 + 7) % 7) + INTERVAL 16 HOUR AS snapshot FROM w""",
)
def slate_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of orders as slates: their part of the season, their phase at an instant, and the Wednesday before on which a snapshot is due."""
    orders = table(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    weeks = orders.groupBy(F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("week")).agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("o_orderstatus") == "F").alias("final"), F.count(F.lit(1)).alias("games")
    )
    now = F.lit("1999-03-04 00:00:00").cast("timestamp")
    phase = time.slate_phase(F.col("first"), F.col("last"), now, F.col("final"), F.col("games"))
    return weeks.select("season", "week", time.week_bucket(F.col("week")).alias("bucket"), phase.alias("phase"), time.snapshot_before(F.col("first")).alias("snapshot"))


_UUID = "substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || printf('%02x', (('0x' || substr(d, 17, 2))::INT & 63) | 128) || substr(d, 19, 2) || '-' || substr(d, 21, 12)"


@query(
    "game_uids",
    f"""WITH g AS (SELECT o_orderkey, YEAR(o_orderdate) AS s, MONTH(o_orderdate) AS w, (['LA', 'LAR', 'KC', 'SF'])[1 + o_custkey % 4] AS a, (['LAC', 'NE'])[1 + o_orderkey % 2] AS h FROM orders),
    n AS (SELECT o_orderkey, 'games:' || concat_ws('|', s, w, a, h) AS strict, 'games:' || concat_ws('|', s, w, CASE WHEN a IN ('LA', 'LAR', 'LAC') THEN 'LA' ELSE a END, CASE WHEN h IN ('LA', 'LAR', 'LAC') THEN 'LA' ELSE h END) AS loose FROM g),
    x AS (SELECT o_orderkey, k, sha1(unhex('{ids.DNS}') || encode(v)) AS d FROM (SELECT o_orderkey, unnest(['uid', 'relaxed_uid']) AS k, unnest([strict, loose]) AS v FROM n))
    SELECT o_orderkey, MAX(CASE WHEN k = 'uid' THEN {_UUID} END) AS uid, MAX(CASE WHEN k = 'relaxed_uid' THEN {_UUID} END) AS relaxed_uid FROM x GROUP BY 1""",
)
def game_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 5 ids of games, and those that read all Los Angeles spellings as one."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    key = F.col("o_orderkey")
    parts = (F.year("o_orderdate"), F.month("o_orderdate"), pick(("LA", "LAR", "KC", "SF"), F.col("o_custkey") % 4), pick(("LAC", "NE"), key % 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.game_uid(*parts).alias("uid"), ids.game_uid(*parts, relaxed=True).alias("relaxed_uid"))


@query(
    "units_and_keys",
    """SELECT c_custkey, ROUND(c_acctbal / 100 * 9 / 5 + 32, 8) AS fahrenheit, ROUND(c_acctbal / 100 * 2.2369362921, 8) AS mph, CASE WHEN c_custkey % 3 > 0 THEN LOWER((['Ann', 'Bo', 'Cy'])[1 + c_custkey % 3]) || ':' || LOWER((['Stone', 'Reed'])[1 + c_custkey % 2]) END AS full_key,
      round_even(c_acctbal / 7, 2) AS rounded FROM customer""",
)
def units_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    cust, balance = F.col("c_custkey"), F.col("c_acctbal")
    first, last = pick(("Ann", "Bo", "Cy"), cust % 3), pick(("Stone", "Reed"), cust % 2)
    name = F.when(cust % 3 == 1, F.concat(last, F.lit(", "), first, F.lit(" Jr."))).when(cust % 3 == 2, F.concat_ws("  ", first, last)).otherwise(first)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(geo.celsius_to_fahrenheit(balance / 100), 8).alias("fahrenheit"), F.round(geo.mps_to_mph(balance / 100), 8).alias("mph"), text.full_key(name).alias("full_key"), teams.round_half_even(balance / 7, 2).alias("rounded")
    )


@query(
    "injury_reports",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (['Out', 'Injured Reserve', 'Doubtful', 'Questionable', NULL])[1 + l_partkey % 5] AS s, (['DNP', 'Limited', 'Full', ''])[1 + l_suppkey % 4] AS p FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, GREATEST(CASE s WHEN 'Out' THEN 1.0 WHEN 'Injured Reserve' THEN 1.0 WHEN 'Doubtful' THEN 0.75 WHEN 'Questionable' THEN 0.4 ELSE 0 END, CASE p WHEN 'DNP' THEN 0.6 WHEN 'Limited' THEN 0.3 ELSE 0 END)::DOUBLE AS severity FROM t""",
)
def injury_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavier of status and practice."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    status, practice = pick(("Out", "Injured Reserve", "Doubtful", "Questionable", None), F.col("l_partkey") % 5), pick(("DNP", "Limited", "Full", ""), F.col("l_suppkey") % 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", football.injury_severity(status, practice).alias("severity"))


@query(
    "csv_round_trip",
    "SELECT o_orderkey, o_totalprice, o_orderstatus, NULL::INT AS week FROM orders UNION ALL SELECT c_custkey, c_acctbal, NULL, c_nationkey FROM customer",
)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables written as CSV and as JSON, read with a schema, one that lacks a column, and conformed."""
    path = folder(spark, "files")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.option("header", True).csv(f"{path}/a.csv")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"), F.col("c_nationkey").alias("week"))
    io.write_json(customers, f"{path}/b.json")
    shape = T.StructType([T.StructField(n, k) for n, k in (("o_orderkey", T.LongType()), ("o_totalprice", T.DoubleType()), ("o_orderstatus", T.StringType()), ("week", T.IntegerType()))])
    first = io.read_table(spark, f"{path}/a.csv", schema=T.StructType(shape.fields[:3]))
    return io.conform(first, shape).unionByName(io.conform(io.read_table(spark, f"{path}/b.json"), shape))


@query(
    "flattened_structs",
    "SELECT c_custkey, c_name AS a_name, c_nationkey AS a_b_nation, '[' || c_custkey % 3 || ']' AS a_list FROM customer",
)
def flattened_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("b"), F.array(F.col("c_custkey") % 3).alias("list")).alias("a")
    return io.jsonable(io.flatten(table(spark, sf_dir, "customer").select("c_custkey", nested)))


@query(
    "selected_features",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax FROM lineitem",
)
def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant column and one with few values are left out."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"same": F.lit(1.0), "rare": F.when(F.col("l_orderkey") < 5, F.col("l_tax"))})
    kept = quality.select_features(rows, ["l_quantity", "same", "rare", "l_tax"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *kept)


@query(
    "row_medians",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT MEDIAN(x) FROM (SELECT unnest([l_quantity, CASE WHEN l_tax > 0.02 THEN l_discount * 1000 END, CASE WHEN l_returnflag = 'R' THEN l_linenumber::DOUBLE END, CASE WHEN l_linestatus = 'O' THEN 30.0 END]) AS x)) AS line FROM lineitem",
)
def row_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians across columns, of as many as are there."""
    c = F.col
    values = (c("l_quantity"), F.when(c("l_tax") > 0.02, c("l_discount") * 1000), F.when(c("l_returnflag") == "R", c("l_linenumber")), F.when(c("l_linestatus") == "O", 30.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bins.row_median(*values).alias("line"))


@query(
    "player_ranks",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, DENSE_RANK() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC) AS depth FROM lineitem",
)
def player_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ranks of players in their game and team; equal values share one."""
    w = windows.ordered(["l_orderkey", "l_returnflag"], ["l_quantity"]).orderBy(F.desc("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.dense_rank().over(w).alias("depth"))


@query(
    "sums_of_what_is_there",
    "SELECT o_custkey % 500 AS team, YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, SUM(CASE WHEN o_orderstatus = 'F' THEN FLOOR(o_totalprice) END) AS total, COUNT(*) AS rows FROM orders GROUP BY 1, 2, 3",
)
def sums_of_what_is_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A team's week without any value has no sum, and not 0."""
    value = F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice").cast("double"))
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("team"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))


@query(
    "nearest_stations",
    """WITH v AS (SELECT c_custkey, (c_custkey * 37) % 179 - 89.0::DOUBLE AS lat, (c_custkey * 91) % 359 - 179.0::DOUBLE AS lon FROM customer), s AS (SELECT s_suppkey, (s_suppkey * 53) % 177 - 88.5::DOUBLE AS lat, (s_suppkey * 29) % 357 - 178.5::DOUBLE AS lon FROM supplier),
    d AS (SELECT c_custkey, s_suppkey, 2 * 6371 * ASIN(SQRT(LEAST(1, SIN(RADIANS(s.lat - v.lat) / 2) ** 2 + COS(RADIANS(v.lat)) * COS(RADIANS(s.lat)) * SIN(RADIANS(s.lon - v.lon) / 2) ** 2))) AS km FROM v, s),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY ROUND(km, 7), s_suppkey) AS rank FROM d WHERE km <= 1500) SELECT c_custkey, s_suppkey, ROUND(km, 5) AS km, rank FROM r WHERE rank <= 3""",
)
def nearest_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers set on the globe, over poles and the date line."""
    key, supp = F.col("c_custkey"), F.col("s_suppkey")
    venues = table(spark, sf_dir, "customer").select("c_custkey", ((key * 37) % 179 - 89.0).alias("lat"), ((key * 91) % 359 - 179.0).alias("lon"))
    stations = table(spark, sf_dir, "supplier").select("s_suppkey", ((supp * 53) % 177 - 88.5).alias("lat"), ((supp * 29) % 357 - 178.5).alias("lon"))
    return joins.nearest_places(venues, stations, "c_custkey", "s_suppkey", 3, 1500.0).withColumn("km", F.round("km", 5))
