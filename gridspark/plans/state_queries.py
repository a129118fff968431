"""States that run through seasons: strengths of teams and health of quarterbacks, on games made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import quarterbacks, sequential
from gridspark.plans.registry import query, table


@query("team_strength")
def team_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of orders as games between a customer's and a supplier's nation; open orders have no score yet, and returns no EPA. Tested against a plain fold."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .filter("c_nationkey <> s_nationkey")
    )
    done = F.bool_and(F.col("l_linestatus") == "F")
    epa = lambda c: F.avg(F.when(F.col("l_returnflag") != "R", c))
    games = lines.groupBy(
        F.pmod("o_orderkey", F.lit(16)).alias("league"), F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("week"),
        F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away"),
    ).agg(
        F.min("o_orderkey").alias("game_id"), F.when(done, F.sum("l_quantity") % 50).alias("home_score"), F.when(done, F.sum(F.col("l_tax") * 500) % 50).alias("away_score"),
        epa(F.col("l_discount") - 0.05).alias("home_epa"), epa(F.col("l_tax") - 0.04).alias("away_epa"),
    )
    return sequential.team_strength(games, "league")


QB_SQL = """WITH RECURSIVE s AS (SELECT YEAR(o_orderdate) AS season, WEEKOFYEAR(o_orderdate) AS week, o_orderkey AS game_id, 'T' || o_custkey % 64 AS h, 'T' || (64 + o_orderkey % 64) AS a,
    CASE WHEN o_custkey % 7 > 0 THEN ' qb ' || o_custkey % 24 END AS hn, CASE WHEN o_custkey % 3 = 0 THEN 'Q' || o_custkey % 24 ELSE ' ' END AS hi, 'Qb ' || o_orderkey % 24 AS an FROM orders),
  t AS (SELECT season, week, game_id, h AS team, NULLIF(UPPER(TRIM(hn)), '') AS n, NULLIF(TRIM(hi), '') AS i FROM s UNION ALL SELECT season, week, game_id, a, UPPER(TRIM(an)), NULL FROM s),
  ro AS (SELECT 'T' || s_suppkey % 128 AS team, 'QB ' || s_suppkey % 24 AS n, MIN('Q' || s_suppkey % 24) AS i FROM supplier GROUP BY 1, 2),
  g AS (SELECT t.season, t.week, t.game_id, t.team, t.n, COALESCE(t.i, ro.i) AS i FROM t LEFT JOIN ro ON ro.team = t.team AND ro.n = t.n),
  sev AS (SELECT YEAR(l_shipdate) AS season, WEEKOFYEAR(l_shipdate) AS week, 'T' || l_suppkey % 128 AS team, UPPER(TRIM(' Qb ' || l_partkey % 24)) AS n, CASE WHEN l_partkey % 2 = 0 THEN 'Q' || l_partkey % 24 END AS i,
    GREATEST(CASE l_returnflag WHEN 'R' THEN 2.0 WHEN 'A' THEN 1.0 ELSE 0.0 END, CASE l_linestatus WHEN 'O' THEN 0.5 ELSE 0.7 END)::DOUBLE AS v FROM lineitem WHERE l_linenumber % 3 = 0),
  bi AS (SELECT season, week, i, MAX(v) AS v FROM sev WHERE i IS NOT NULL GROUP BY ALL), bn AS (SELECT season, week, team, n, MAX(v) AS v FROM sev GROUP BY ALL),
  f AS (SELECT g.*, COALESCE(bi.v, bn.v, 0.0) AS flag, ROW_NUMBER() OVER (PARTITION BY g.team ORDER BY g.season, g.week, game_id) AS r FROM g LEFT JOIN bi ON bi.season = g.season AND bi.week = g.week AND bi.i = g.i
    LEFT JOIN bn ON bn.season = g.season AND bn.week = g.week AND bn.team = g.team AND bn.n = g.n),
  e AS (SELECT team, r, flag AS m FROM f WHERE r = 1 UNION ALL SELECT f.team, f.r, e.m * 0.5 + f.flag * 0.5 FROM e JOIN f ON f.team = e.team AND f.r = e.r + 1)
  SELECT f.season, f.week, f.game_id, f.team, f.i AS qb_player_id, flag AS qb_status_flag, ROUND(COALESCE(flag - AVG(flag) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 6) AS qb_status_delta_rolling3,
    COALESCE(LAG(flag) OVER w >= 1, FALSE)::INT AS qb_missed_last_game, (COUNT(*) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))::DOUBLE AS qb_games_started_rolling5, FLOOR(COALESCE(e.m, 0) * 1073741824 + 0.5) / 1073741824 AS qb_recovery_score_rolling3,
    LEAST(8, COALESCE(f.r - 1 - MAX(CASE WHEN flag >= 1.5 THEN f.r END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 8))::DOUBLE AS qb_weeks_since_injury
  FROM f LEFT JOIN e ON e.team = f.team AND e.r = f.r - 1 WINDOW w AS (PARTITION BY f.team ORDER BY f.season, f.week, f.game_id)"""


@query("quarterback_health", QB_SQL)
def quarterback_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games, every third line of an order as an injury report of one of 24 quarterbacks."""
    cust, key, team = F.col("o_custkey"), F.col("o_orderkey"), lambda n: F.concat(F.lit("T"), n.cast("string"))
    text = lambda prefix, n: F.concat(F.lit(prefix), (n % 24).cast("string"))
    schedule = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("week"), key.alias("game_id"), team(cust % 64).alias("home_team"), team(64 + key % 64).alias("away_team"),
        F.when(cust % 7 > 0, text(" qb ", cust)).alias("home_qb_name"), F.when(cust % 3 == 0, text("Q", cust)).otherwise(" ").alias("home_qb_id"),
        text("Qb ", key).alias("away_qb_name"), F.lit(None).cast("string").alias("away_qb_id"),
    )
    part = F.col("l_partkey")
    injuries = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.weekofyear("l_shipdate").alias("week"), team(F.col("l_suppkey") % 128).alias("team"),
        F.when(F.col("l_linenumber") % 3 == 0, "qb").when(F.col("l_linenumber") % 3 == 1, "WR").alias("position"), text(" Qb ", part).alias("player_name"),
        F.when(part % 2 == 0, text("Q", part)).alias("player_id"), F.when(F.col("l_returnflag") == "R", "Ruled Out").when(F.col("l_returnflag") == "A", "Questionable").alias("status"),
        F.when(F.col("l_linestatus") == "O", "Limited Participation").otherwise("Did Not Practice").alias("practice"),
    )
    supp = F.col("s_suppkey")
    roster = table(spark, sf_dir, "supplier").select(team(supp % 128).alias("team"), text("QB ", supp).alias("full_name"), text("Q", supp).alias("gsis_id"))
    out = quarterbacks.quarterback_health(schedule, injuries, roster)
    #: To 30 binary places: halves of halves lie on decimal ties.
    places = F.floor(F.col("qb_recovery_score_rolling3") * (1 << 30) + 0.5) / (1 << 30)
    return out.withColumns({"qb_status_delta_rolling3": F.round("qb_status_delta_rolling3", 6), "qb_recovery_score_rolling3": places})
