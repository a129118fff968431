"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import bins, geo, odds, text
from gridspark.plans.registry import query, table


@query(
    "odds_family",
    """WITH o AS (SELECT p_partkey, (p_partkey % 401 - 200)::DOUBLE AS o FROM part),
    d AS (SELECT *, CASE WHEN o > 0 THEN 1 + o / 100 WHEN o < 0 THEN 1 + 100 / ABS(o) END AS dec FROM o)
    SELECT p_partkey, ROUND(dec, 8) AS price, CASE WHEN dec >= 2 THEN ROUND((dec - 1) * 100) WHEN dec > 1 THEN ROUND(-100 / (dec - 1)) END AS american,
      ROUND(CASE WHEN o > 0 THEN 100 / (o + 100) WHEN o < 0 THEN ABS(o) / (ABS(o) + 100) ELSE 0.5 END, 8) AS implied,
      ROUND(CASE WHEN o > 0 THEN o / 100 WHEN o < 0 THEN 100 / ABS(o) END, 8) AS profit FROM d""",
)
def odds_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = (F.col("p_partkey") % 401 - 200).cast("double")
    price = odds.american_to_decimal(o)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(price, 8).alias("price"), odds.decimal_to_american(price).alias("american"),
        F.round(odds.american_to_implied(o), 8).alias("implied"), F.round(odds.profit_per_unit(o), 8).alias("profit"),
    )


@query(
    "probability_family",
    """WITH x AS (SELECT p_partkey, (p_partkey % 97 + 1) / 100.0::DOUBLE AS p, (p_partkey % 89 + 2) / 100.0::DOUBLE AS q, 1.1 + p_size / 10.0::DOUBLE AS d FROM part)
    SELECT p_partkey, ROUND(p / (p + q), 8) AS no_vig, ROUND(p * (d - 1) - (1 - p), 8) AS ev, ROUND(GREATEST(0, ((d - 1) * p - (1 - p)) / (d - 1) * 0.5), 8) AS kelly,
      ROUND(1 / (1 + 10 ** (-(1500 + p * 100 + 55 - 1500 - q * 100) / 400)), 8) AS elo, ROUND(LN(p / (1 - p)), 8) AS logit, ROUND(1 / (1 + EXP(-(p - q))), 8) AS sigmoid,
      ROUND(p + (q - p) * 0.3, 8) AS shrunk, ROUND(LEAST(GREATEST(p, 0.2), 0.8), 8) AS capped FROM x""",
)
def probability_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q, d = (F.col("p_partkey") % 97 + 1) / 100.0, (F.col("p_partkey") % 89 + 2) / 100.0, 1.1 + F.col("p_size") / 10.0
    found = {
        "no_vig": odds.no_vig(p, q), "ev": odds.expected_value(p, d), "kelly": odds.kelly(p, d, 0.5), "elo": odds.elo_probability(1500 + p * 100, 1500 + q * 100, 55.0),
        "logit": odds.logit(p), "sigmoid": odds.sigmoid(p - q), "shrunk": odds.shrink_to(p, q, F.lit(0.3)), "capped": odds.capped(p, F.lit(0.2), F.lit(0.8)),
    }
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 8).alias(n) for n, c in found.items()])


@query(
    "normal_cdf",
    """WITH z AS (SELECT p_partkey, (p_partkey % 801 - 400) / 100.0::DOUBLE AS z FROM part), t AS (SELECT *, ABS(z) / SQRT(2.0) AS x, 1 / (1 + 0.3275911 * ABS(z) / SQRT(2.0)) AS t FROM z),
    h AS (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * EXP(-x * x) / 2 AS h FROM t)
    SELECT p_partkey, ROUND(CASE WHEN z >= 0 THEN 1 - h ELSE h END, 7) AS cover FROM h""",
)
def normal_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.col("p_partkey") % 801 - 400) / 100.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(odds.normal_cdf(z), 7).alias("cover"))


@query(
    "haversine",
    """WITH c AS (SELECT c_custkey, c_custkey % 120 - 60.0::DOUBLE AS a, c_custkey % 300 - 150.0::DOUBLE AS b, c_nationkey * 2.0::DOUBLE AS c, c_nationkey * -3.0::DOUBLE AS d FROM customer)
    SELECT c_custkey, ROUND(2 * 6371.0 * ASIN(SQRT(LEAST(1, SIN(RADIANS(c - a) / 2) ** 2 + COS(RADIANS(a)) * COS(RADIANS(c)) * SIN(RADIANS(d - b) / 2) ** 2))), 4) AS km, a * 9 / 5 + 32 AS fahrenheit FROM c""",
)
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("c_custkey") % 120 - 60).cast("double"), (F.col("c_custkey") % 300 - 150).cast("double")
    km = geo.haversine_km(a, b, F.col("c_nationkey") * 2.0, F.col("c_nationkey") * -3.0)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(km, 4).alias("km"), geo.celsius_to_fahrenheit(a).alias("fahrenheit"))


@query(
    "text_family",
    """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
      CASE WHEN contains(lower(p_name), 'red') THEN 3.0::DOUBLE WHEN contains(lower(p_name), 'b') THEN 2.0 ELSE 0.0 END AS severity,
      md5(p_name) AS cache_key, lower(p_name) IN ('red widget', 'blue bolt') AS flagged, regexp_extract(p_brand, '[0-9]+') AS milestone FROM part""",
)
def text_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.slug(F.concat_ws(" / ", "p_brand", "p_type")).alias("slug"), text.ladder(F.col("p_name"), [("red", 3.0), ("b", 2.0)], 0.0).alias("severity"),
        F.md5("p_name").alias("cache_key"), F.lower("p_name").isin("red widget", "blue bolt").alias("flagged"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("milestone"),
    )


@query(
    "number_cleaning",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (p_size * 60 + 7)::DOUBLE WHEN 1 THEN p_size + 0.5 WHEN 2 THEN p_size * 1000.0 WHEN 3 THEN NULL ELSE -p_size END AS value, p_size::VARCHAR AS id FROM part""",
)
def number_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    raw = F.when(kind == 0, F.concat(size, F.lit(":07"))).when(kind == 1, F.concat(size, F.lit(".5%"))).when(kind == 2, F.concat(size, F.lit(",000"))).when(kind == 3, "--").otherwise(F.concat(F.lit("−"), size))
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_number(raw).alias("value"), text.text_id(F.concat(size, F.lit(".0"))).alias("id"))


@query(
    "json_family",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, COALESCE(CAST(json_extract(props, '$.k') AS BIGINT) > 50, FALSE) AS high FROM events""",
)
def json_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("high"))


@query(
    "array_family",
    """SELECT vec_id, len(embedding) AS dims, ROUND(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS norm2, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings""",
)
def array_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size("embedding").cast("bigint").alias("dims"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm2"),
        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("positive"),
    )


@query(
    "bin_labels",
    """SELECT p_partkey, CASE WHEN p_size < 5 THEN '<5' WHEN p_size >= 40 THEN '>=40' WHEN p_size < 10 THEN '5-10' WHEN p_size < 20 THEN '10-20' ELSE '20-40' END AS band FROM part""",
)
def bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", bins.label(F.col("p_size"), [5, 10, 20, 40]).alias("band"))


@query(
    "zone_conversion",
    """SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS local, DATE_DIFF('hour', ts, timezone('America/New_York', timezone('UTC', ts)))::DOUBLE AS offset_hours FROM events""",
)
def zone_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    local = F.from_utc_timestamp(at, "America/New_York").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", local.alias("local"), geo.zone_offset_hours(at, "America/New_York").alias("offset_hours"))


@query(
    "feature_fingerprint",
    """SELECT p_partkey, substring(sha1(printf('%.6f', p_size::DOUBLE) || '|' || printf('%.6f', p_retailprice)), 1, 16) AS fingerprint,
      sha1(array_to_string(list_sort([p_brand, p_type]), '|')) AS set_hash FROM part""",
)
def feature_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = text.fingerprint([F.col("p_size"), F.col("p_retailprice")]).alias("fingerprint")
    return table(spark, sf_dir, "part").select("p_partkey", named, text.set_hash(F.array("p_brand", "p_type")).alias("set_hash"))
