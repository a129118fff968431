"""Prior-form windows on weekly customer revenue and on user events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions import bins
from gridspark.operators import sequential, windows
from gridspark.plans.registry import query, table

WEEKLY_SQL = """weekly AS (
  SELECT o_custkey AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS period,
         CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value, COUNT(*) AS n,
         COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done
  FROM orders GROUP BY 1, 2)"""


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in whole cents: sums of them do not depend on their order."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("entity"), F.date_trunc("week", "o_orderdate").cast("date").alias("period"))
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("value"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    )


def over_weeks():
    return windows.ordered(["entity"], ["period"])


@query(
    "prior_form_weekly",
    """
    WITH weekly AS (
      SELECT o_custkey AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS period,
             CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * (100 - CAST(ROUND(l_discount * 100) AS BIGINT))) AS BIGINT) AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    form AS (
      SELECT *, CAST(FLOOR(AVG(value) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS BIGINT) AS p
      FROM weekly)
    SELECT entity, period, value, p AS prior3, p - AVG(p) OVER (PARTITION BY period) AS prior3_vs_league FROM form
    """,
)
def prior_form_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of an entity's last three periods, and its distance from the period's league mean; in units of 0.0001."""
    revenue = F.round(F.col("l_extendedprice") * 100).cast("bigint") * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))
    weeks = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("entity"), F.date_trunc("week", "o_orderdate").cast("date").alias("period"))
        .agg(F.sum(revenue).alias("value"))
    )
    form = weeks.withColumn("prior3", F.floor(windows.prior_mean(F.col("value"), over_weeks(), 3)).cast("bigint"))
    return form.withColumn("prior3_vs_league", F.col("prior3") - F.avg("prior3").over(Window.partitionBy("period")))


@query(
    "prior_expanding",
    f"""WITH {WEEKLY_SQL} SELECT entity, period,
      AVG(value) OVER w AS prior_mean, ROUND(STDDEV_SAMP(value / 100.0::DOUBLE) OVER w, 3) AS prior_std, COUNT(value) OVER w AS prior_n,
      AVG(value) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prior5
    FROM weekly WINDOW w AS (PARTITION BY entity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = over_weeks(), F.col("value")
    return weekly(spark, sf_dir).select(
        "entity", "period", windows.prior_mean(v, w).alias("prior_mean"), F.round(windows.prior_std(v / 100.0, w), 3).alias("prior_std"),
        windows.prior_count(v, w).alias("prior_n"), windows.prior_mean(v, w, 5).alias("prior5"),
    )


@query(
    "lag_delta_pct",
    f"""WITH {WEEKLY_SQL}, l AS (SELECT entity, period, LAG(n) OVER w AS a, LAG(n, 2) OVER w AS b FROM weekly
      WINDOW w AS (PARTITION BY entity ORDER BY period))
    SELECT entity, period, a AS n_prev, a - b AS n_delta, ROUND((a - b) / CAST(NULLIF(ABS(b), 0) AS DOUBLE), 6) AS n_pct FROM l""",
)
def lag_delta_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lag_features(weekly(spark, sf_dir), "n", over_weeks()).select(
        "entity", "period", "n_prev", "n_delta", F.round("n_pct", 6).alias("n_pct")
    )


EVENTS_SQL = "ev AS (SELECT event_id, user_id, ts, event_type, value, event_type = 'error' AS bad FROM events)"


@query(
    "run_length",
    f"""WITH {EVENTS_SQL}, i AS (SELECT *, SUM(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM ev)
    SELECT event_id, CAST(CASE WHEN bad THEN SUM(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) ELSE 0 END AS BIGINT) AS streak FROM i""",
)
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return windows.run_length(events, F.col("event_type") == "error", ["user_id"], ["event_id"], "streak").select("event_id", F.col("streak").cast("bigint").alias("streak"))


@query(
    "since_flag",
    f"""WITH {EVENTS_SQL} SELECT event_id, event_id - MAX(CASE WHEN bad THEN event_id END) OVER
      (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM ev""",
)
def since_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.since_flag(table(spark, sf_dir, "events"), F.col("event_type") == "error", "event_id", ["user_id"], "since").select("event_id", "since")


@query(
    "carry_forward",
    """SELECT event_id, LAST_VALUE(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER
      (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""",
)
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", windows.carry_forward(bought, windows.ordered(["user_id"], ["event_id"])).alias("last_purchase"))


@query(
    "ewm_prior",
    f"""WITH RECURSIVE {WEEKLY_SQL}, o AS (SELECT entity, period, CASE WHEN done > 0 THEN value END::DOUBLE AS v, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY period) AS i FROM weekly),
    r AS (SELECT entity, i, v AS m, 1.0::DOUBLE AS w FROM o WHERE i = 1 UNION ALL
          SELECT o.entity, o.i, CASE WHEN o.v IS NULL THEN r.m WHEN r.m IS NULL THEN o.v ELSE (r.w * 0.5 * r.m + 0.5 * o.v) / (r.w * 0.5 + 0.5) END, CASE WHEN o.v IS NULL THEN r.w * 0.5 ELSE 1.0 END
          FROM r JOIN o ON o.entity = r.entity AND o.i = r.i + 1)
    SELECT o.entity, o.period, r.m AS ewm3 FROM o LEFT JOIN r ON r.entity = o.entity AND r.i = o.i - 1""",
)
def ewm_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks without a finished order have no value; they age what came before."""
    weeks = weekly(spark, sf_dir).withColumn("finished", F.when(F.col("done") > 0, F.col("value")))
    return windows.ewm_prior(weeks, "finished", ["entity"], ["period"], 3, "ewm3").select("entity", "period", "ewm3")


@query(
    "drawdown",
    """WITH b AS (SELECT event_id, user_id, SUM(CASE WHEN event_type = 'error' THEN -value ELSE value END) OVER (PARTITION BY user_id ORDER BY event_id) + 1000 AS bank FROM events),
    p AS (SELECT *, MAX(bank) OVER (PARTITION BY user_id ORDER BY event_id) AS peak FROM b)
    SELECT event_id, ROUND(peak, 3) AS peak, ROUND((peak - bank) / peak, 6) AS drawdown FROM p""",
)
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value"))
    bank = table(spark, sf_dir, "events").withColumn("bank", F.sum(flow).over(windows.ordered(["user_id"], ["event_id"])) + 1000)
    return windows.drawdown(bank, "bank", ["user_id"], ["event_id"]).select("event_id", F.round("peak", 3).alias("peak"), F.round("drawdown", 6).alias("drawdown"))


@query(
    "bankroll_kelly",
    """SELECT event_id, ROUND(100 * EXP(SUM(LN(1 + CASE WHEN event_type = 'error' THEN -0.02 ELSE 0.005 END)) OVER (PARTITION BY user_id ORDER BY event_id)), 6) AS bankroll FROM events""",
)
def bankroll_kelly(spark: SparkSession, sf_dir: str) -> DataFrame:
    growth = F.when(F.col("event_type") == "error", -0.02).otherwise(0.005)
    return windows.compound(table(spark, sf_dir, "events"), growth, ["user_id"], ["event_id"], 100.0, "b").select("event_id", F.round("b", 6).alias("bankroll"))


@query(
    "first_last_flags",
    """SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_first,
      ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_last FROM events""",
)
def first_last_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_last_flags(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "is_first", "is_last")


@query(
    "pct_rank_average_ties",
    """WITH r AS (SELECT p_partkey, p_brand, p_size, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS lo,
      COUNT(*) OVER (PARTITION BY p_brand, p_size) AS same, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_partkey, ROUND((lo + (same - 1) / 2.0) / n, 6) AS pct FROM r""",
)
def pct_rank_average_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = Window.partitionBy("p_brand")
    pct = bins.average_percent_rank(F.col("p_size"), brand.orderBy("p_size"), Window.partitionBy("p_brand", "p_size"), brand)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(pct, 6).alias("pct"))


@query(
    "schedule_rest_days",
    """SELECT o_orderkey, DATE_DIFF('day', LAG(o_orderdate) OVER w, o_orderdate) AS rest_days,
      COALESCE(LAG(o_orderstatus) OVER w = 'F', FALSE) AS prev_final FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def schedule_rest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.ordered(["o_custkey"], ["o_orderdate", "o_orderkey"])
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("bigint").alias("rest_days"),
        F.coalesce(F.lag("o_orderstatus").over(w) == "F", F.lit(False)).alias("prev_final"),
    )


ELO_SQL = """WITH RECURSIVE games AS (SELECT o_orderkey % 16 AS league, YEAR(o_orderdate) AS season, WEEKOFYEAR(o_orderdate) AS week, c_nationkey AS home, s_nationkey AS away, MIN(o_orderkey) AS game_id,
    SUM(l_quantity) AS hs, SUM(l_tax * 500) AS aws FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY ALL),
  k AS (SELECT *, DENSE_RANK() OVER (PARTITION BY league ORDER BY season, week) AS i FROM games),
  w AS (SELECT league, i, MAX(season) AS season, list({'h': home, 'a': away, 'm': hs - aws} ORDER BY game_id::VARCHAR, home, away) AS gs FROM k GROUP BY 1, 2),
  r AS (SELECT league, 1::BIGINT AS i, season, list_transform(range(25), lambda t: 1500.0::DOUBLE) AS e FROM w WHERE i = 1
    UNION ALL SELECT league, i, season, list_transform(range(25), lambda t: CASE WHEN season <> before THEN n[t + 1] + 0.33 * (1500 - n[t + 1]) ELSE n[t + 1] END) FROM (
      SELECT x.league, y.i, y.season, x.season AS before, list_transform(range(25), lambda t: x.e[t + 1] + COALESCE(list_sum(list_transform(x.gs, lambda g: CASE WHEN g.h = t THEN g.s WHEN g.a = t THEN -g.s ELSE 0 END)), 0)) AS n
      FROM (SELECT league, i, season, e, list_transform(gs, lambda g: {'h': g.h, 'a': g.a, 's': 20.0 * LN(ABS(g.m) + 1) * 2.2 / (GREATEST((e[g.h + 1] + 55 - e[g.a + 1]) * CASE WHEN g.m >= 0 THEN 1 ELSE -1 END, -2000) * 0.001 + 2.2)
          * (CASE WHEN g.m = 0 THEN 0.5 WHEN g.m > 0 THEN 1 ELSE 0 END - 1 / (1 + POW(10, -(e[g.h + 1] + 55 - e[g.a + 1]) / 400)))}) AS gs FROM (SELECT r.league, r.i, r.season, r.e, w.gs FROM r JOIN w ON w.league = r.league AND w.i = r.i)) x
      JOIN w y ON y.league = x.league AND y.i = x.i + 1))
  SELECT k.league, k.season, k.week, k.game_id::VARCHAR AS game_id, k.home::VARCHAR AS home, k.away::VARCHAR AS away, ROUND(e[home + 1], 4) AS home_elo, ROUND(e[away + 1], 4) AS away_elo,
    ROUND(1 / (1 + POW(10, -(e[home + 1] + 55 - e[away + 1]) / 400)), 6) AS home_probability FROM k JOIN r ON r.league = k.league AND r.i = k.i"""


@query("elo_ratings", ELO_SQL)
def elo_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of orders as games between a customer's and a supplier's nation, scored by the lines between them; leagues by order number."""
    games = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .filter("c_nationkey <> s_nationkey")
        .groupBy(F.pmod("o_orderkey", F.lit(16)).alias("league"), F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("week"), F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away"))
        .agg(F.min("o_orderkey").alias("game_id"), F.sum("l_quantity").alias("home_score"), F.sum(F.col("l_tax") * 500).alias("away_score"))
    )
    out = sequential.elo(games, "league")
    return out.withColumns({"home_elo": F.round("home_elo", 4), "away_elo": F.round("away_elo", 4), "home_probability": F.round("home_probability", 6)})
