"""Play-by-play features on order lines read as plays, and market tables on orders read as games."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import football, market
from gridspark.plans.registry import query, table

PLAYS_SQL = """plays AS (SELECT YEAR(l_shipdate) AS season, WEEK(l_shipdate) AS week, l_orderkey AS game_id, l_linenumber AS play_id, l_partkey AS player_id,
  l_suppkey % 32 AS posteam, (l_suppkey + l_linenumber) % 32 AS defteam, l_linenumber // 3 AS drive, l_quantity - 25 AS epa, (l_returnflag <> 'N')::INT AS pass_attempt,
  (l_tax >= 0.08)::INT AS sack, (l_partkey % 11 = 0)::INT AS qb_scramble, l_partkey % 100 AS yardline_100, (l_partkey % 13 = 0)::INT AS touchdown,
  (l_partkey % 100 <= 20)::INT AS drive_inside20, (l_suppkey % 5 = 0)::INT AS drive_ended_with_score FROM lineitem)"""


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    flag = lambda c: c.cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.weekofyear("l_shipdate").alias("week"), F.col("l_orderkey").alias("game_id"), line.alias("play_id"), part.alias("player_id"),
        (supp % 32).alias("posteam"), ((supp + line) % 32).alias("defteam"), F.floor(line / 3).alias("drive"), (F.col("l_quantity") - 25).alias("epa"),
        flag(F.col("l_returnflag") != "N").alias("pass_attempt"), flag(F.col("l_tax") >= 0.08).alias("sack"), flag(part % 11 == 0).alias("qb_scramble"), (part % 100).alias("yardline_100"),
        flag(part % 13 == 0).alias("touchdown"), flag(part % 100 <= 20).alias("drive_inside20"), flag(supp % 5 == 0).alias("drive_ended_with_score"),
    )


def rounded(df: DataFrame, columns: list[str], digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "passing_epa",
    f"""WITH {PLAYS_SQL}, w AS (SELECT season, week, posteam AS team, SUM(epa) AS pass_epa, COUNT(*) AS dropbacks, SUM(epa) / COUNT(*) AS r FROM plays WHERE pass_attempt = 1 OR sack = 1 GROUP BY 1, 2, 3),
    x AS (SELECT *, AVG(r) OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM w)
    SELECT season, week, team, pass_epa, dropbacks, ROUND(r, 8) AS pass_epa_per_db, ROUND(m, 8) AS pass_epa_per_db_rolling3, ROUND(m - AVG(m) OVER (PARTITION BY season, week), 8) AS pass_epa_per_db_rolling3_vs_league FROM x""",
)
def passing_epa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(football.passing_epa(plays(spark, sf_dir)), ["pass_epa_per_db", "pass_epa_per_db_rolling3", "pass_epa_per_db_rolling3_vs_league"])


@query(
    "drive_epa",
    f"""WITH {PLAYS_SQL}, d AS (SELECT season, week, game_id, posteam AS team, drive, SUM(epa) AS epa, COUNT(*) AS plays, MAX(drive_ended_with_score) AS scored, MAX(drive_inside20) AS inside20 FROM plays GROUP BY ALL),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, team ORDER BY drive, season, week) = 1 AS first FROM d)
    SELECT season, week, team, game_id, COUNT(*) AS drives, ROUND(AVG(epa), 8) AS epa_per_drive, ROUND(AVG(plays), 8) AS plays_per_drive, ROUND(AVG(scored), 8) AS score_rate,
      ROUND(AVG(inside20), 8) AS inside20_rate FROM o GROUP BY 1, 2, 3, 4""",
)
def drive_epa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(football.drive_epa(plays(spark, sf_dir)).drop("opening_epa"), ["epa_per_drive", "plays_per_drive", "score_rate", "inside20_rate"])


@query(
    "red_zone",
    f"""WITH {PLAYS_SQL}, t AS (SELECT season, week, game_id, posteam, defteam, drive, MAX(touchdown) AS td FROM plays WHERE yardline_100 <= 20 GROUP BY ALL),
    a AS (SELECT season, week, posteam AS team, COUNT(*) AS trips, SUM(td)::BIGINT AS tds FROM t GROUP BY 1, 2, 3), b AS (SELECT season, week, defteam AS team, COUNT(*) AS trips_allowed, SUM(td)::BIGINT AS tds_allowed FROM t GROUP BY 1, 2, 3)
    SELECT season, week, team, trips, tds, trips_allowed, tds_allowed, ROUND(tds / trips::DOUBLE, 8) AS td_rate, ROUND(tds_allowed / trips_allowed::DOUBLE, 8) AS td_rate_allowed FROM a FULL JOIN b USING (season, week, team)""",
)
def red_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(football.red_zone(plays(spark, sf_dir)), ["td_rate", "td_rate_allowed"])


@query(
    "pressure_rates",
    f"""WITH {PLAYS_SQL}, d AS (SELECT *, GREATEST(sack, qb_scramble) AS p FROM plays WHERE pass_attempt = 1 OR sack = 1 OR qb_scramble = 1),
    a AS (SELECT season, week, posteam AS team, SUM(p) / COUNT(*)::DOUBLE AS x FROM d GROUP BY 1, 2, 3), b AS (SELECT season, week, defteam AS team, SUM(p) / COUNT(*)::DOUBLE AS y FROM d GROUP BY 1, 2, 3)
    SELECT season, week, team, ROUND(x, 8) AS pressure_allowed, ROUND(y, 8) AS pressure_made FROM a FULL JOIN b USING (season, week, team)""",
)
def pressure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(football.pressure(plays(spark, sf_dir)), ["pressure_allowed", "pressure_made"])


@query(
    "team_season_offence",
    f"""WITH {PLAYS_SQL} SELECT season, posteam AS team, COUNT(*) AS plays, SUM(epa) AS epa, ROUND(SUM(epa) / COUNT(*), 8) AS epa_per_play, ROUND(SUM(pass_attempt) / COUNT(*)::DOUBLE, 8) AS pass_share, SUM(touchdown)::BIGINT AS touchdowns FROM plays GROUP BY 1, 2""",
)
def team_season_offence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(football.team_season(plays(spark, sf_dir), "posteam"), ["epa_per_play", "pass_share"])


@query(
    "touchdown_events",
    f"""WITH {PLAYS_SQL}, t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY play_id, player_id, posteam) = 1 AS f, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY play_id DESC, player_id DESC, posteam DESC) = 1 AS l FROM plays WHERE touchdown = 1)
    SELECT game_id, player_id, COUNT(*) AS touchdowns, BOOL_OR(f) AS first_td, BOOL_OR(l) AS last_td FROM t GROUP BY 1, 2""",
)
def touchdown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return football.touchdown_events(plays(spark, sf_dir), "player_id", ["play_id", "player_id", "posteam"])


@query(
    "injury_grid",
    """WITH g AS (SELECT DISTINCT YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, o_custkey % 16 AS team FROM orders),
    r AS (SELECT YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, o_custkey % 16 AS team, COUNT(*)::DOUBLE AS inj_out FROM orders WHERE o_totalprice > 497000 GROUP BY 1, 2, 3),
    k AS (SELECT season, week, team, CASE WHEN w.hit THEN COALESCE(inj_out, 0) END AS v FROM g LEFT JOIN r USING (season, week, team) LEFT JOIN (SELECT DISTINCT season, week, TRUE AS hit FROM r) w USING (season, week))
    SELECT season, week, team, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY team, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inj_out FROM k""",
)
def injury_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), (F.col("o_custkey") % 16).alias("home_team"), "o_totalprice"
    )
    reports = orders.filter("o_totalprice > 497000").groupBy("season", "week", F.col("home_team").alias("team")).agg(F.count(F.lit(1)).cast("double").alias("inj_out"))
    return football.injury_grid(reports, orders.withColumn("away_team", F.col("home_team")), ["inj_out"])


@query(
    "rest_days_both_sides",
    """WITH g AS (SELECT o_orderkey AS game_id, o_orderdate::DATE AS gameday, o_custkey % 40 AS h, 40 + o_custkey % 41 AS a FROM orders),
    r AS (SELECT game_id, gameday, h AS team, 'home' AS side FROM g UNION ALL SELECT game_id, gameday, a, 'away' FROM g),
    d AS (SELECT *, DATE_DIFF('day', LAG(gameday) OVER (PARTITION BY team ORDER BY gameday, game_id), gameday)::INT AS rest FROM r)
    SELECT game_id, MAX(rest) FILTER (WHERE side = 'home') AS home_rest, MAX(rest) FILTER (WHERE side = 'away') AS away_rest, MAX(rest) FILTER (WHERE side = 'home') - MAX(rest) FILTER (WHERE side = 'away') AS rest_diff FROM d GROUP BY 1""",
)
def rest_days_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"), F.col("o_orderdate").cast("date").alias("gameday"), (F.col("o_custkey") % 40).alias("home_team"), (40 + F.col("o_custkey") % 41).alias("away_team")
    )
    return football.rest_and_travel(games)


GAMES_SQL = """games AS (SELECT o_orderkey AS game_id, YEAR(o_orderdate) AS season, ((o_custkey * 37) % 99 + 1) / 100.0::DOUBLE AS home_win_prob, (o_orderkey % 29 - 14)::DOUBLE AS home_margin,
  (o_custkey % 17 - 8) * 0.5::DOUBLE AS spread_line, (o_orderkey % 21 - 10)::DOUBLE AS pred_home_margin,
  (CASE WHEN o_custkey % 3 = 0 THEN 110 + o_custkey % 200 WHEN o_custkey % 50 = 1 THEN NULL ELSE -(105 + o_custkey % 250) END)::DOUBLE AS home_moneyline,
  (CASE WHEN o_custkey % 3 = 0 THEN -(130 + o_custkey % 200) ELSE 100 + o_custkey % 250 END)::DOUBLE AS away_moneyline FROM orders),
i AS (SELECT *, CASE WHEN home_moneyline > 0 THEN 100 / (home_moneyline + 100) ELSE -home_moneyline / (100 - home_moneyline) END AS h, CASE WHEN away_moneyline > 0 THEN 100 / (away_moneyline + 100) ELSE -away_moneyline / (100 - away_moneyline) END AS a FROM games)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    home = F.when(cust % 3 == 0, 110 + cust % 200).when(cust % 50 != 1, -(105 + cust % 250)).cast("double")
    away = F.when(cust % 3 == 0, -(130 + cust % 200)).otherwise(100 + cust % 250).cast("double")
    return table(spark, sf_dir, "orders").select(
        key.alias("game_id"), F.year("o_orderdate").alias("season"), (((cust * 37) % 99 + 1) / 100.0).alias("home_win_prob"), (key % 29 - 14).cast("double").alias("home_margin"),
        ((cust % 17 - 8) * 0.5).alias("spread_line"), (key % 21 - 10).cast("double").alias("pred_home_margin"), home.alias("home_moneyline"), away.alias("away_moneyline"),
    )


@query(
    "market_benchmark",
    f"""WITH {GAMES_SQL}, n AS (SELECT *, h / (h + a) AS hn, a / (h + a) AS an, home_win_prob >= 0.5 AS model_home FROM i)
    SELECT game_id, ROUND(hn, 8) AS home_implied_prob_novig, model_home, hn >= 0.5 AS market_home, model_home = (hn >= 0.5) AS favorite_agreement,
      ROUND(GREATEST(home_win_prob, 1 - home_win_prob) - CASE WHEN model_home THEN hn ELSE an END, 8) AS prob_edge_model_side,
      ROUND(CASE WHEN CASE WHEN model_home THEN home_moneyline ELSE away_moneyline END IS NULL THEN NULL WHEN home_margin = 0 THEN 0.0::DOUBLE WHEN model_home = (home_margin > 0) THEN
        CASE WHEN CASE WHEN model_home THEN home_moneyline ELSE away_moneyline END > 0 THEN CASE WHEN model_home THEN home_moneyline ELSE away_moneyline END / 100
        ELSE 100 / ABS(CASE WHEN model_home THEN home_moneyline ELSE away_moneyline END) END ELSE -1.0 END, 8) AS model_side_profit FROM n""",
)
def market_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["home_implied_prob_novig", "prob_edge_model_side", "model_side_profit"]
    return rounded(market.benchmark(games(spark, sf_dir)), columns).select("game_id", *columns, "model_home", "market_home", "favorite_agreement")


@query(
    "spread_grades",
    f"""WITH {GAMES_SQL} SELECT game_id, pred_home_margin - spread_line AS edge_points, home_margin - spread_line AS result_points, CASE WHEN pred_home_margin >= spread_line THEN 'home' ELSE 'away' END AS side,
      CASE WHEN home_margin = spread_line THEN 'push' WHEN (pred_home_margin >= spread_line AND home_margin > spread_line) OR (pred_home_margin < spread_line AND home_margin < spread_line) THEN 'win' ELSE 'loss' END AS grade FROM games""",
)
def spread_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.spread_grade(games(spark, sf_dir)).select("game_id", "edge_points", "result_points", "side", "grade")


@query(
    "closing_line_value",
    f"""WITH {GAMES_SQL}, c AS (SELECT game_id, h AS now, CASE WHEN away_moneyline > 0 THEN 100 / (away_moneyline + 100) ELSE -away_moneyline / (100 - away_moneyline) END - h AS v FROM i WHERE home_moneyline IS NOT NULL)
    SELECT game_id, ROUND(v, 8) AS clv, CASE WHEN v > 0 THEN 'beat' WHEN v < 0 THEN 'lost' ELSE 'even' END AS clv_status FROM c""",
)
def closing_line_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The away price read as the home side's close."""
    rows = games(spark, sf_dir).filter("home_moneyline IS NOT NULL")
    picks = rows.select("game_id", F.lit("home").alias("side"), F.col("home_moneyline").alias("odds"))
    close = rows.select("game_id", F.col("away_moneyline").alias("home_close"), F.col("away_moneyline").alias("away_close"))
    return market.closing_line_value(picks, close).select("game_id", F.round("clv", 8).alias("clv"), "clv_status")


@query(
    "best_price",
    """WITH o AS (SELECT l_orderkey, l_suppkey, l_linenumber, (CASE WHEN l_partkey % 2 = 0 THEN 100 + l_partkey % 150 ELSE -(100 + l_partkey % 200) END)::DOUBLE AS odds FROM lineitem),
    d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN odds > 0 THEN 1 + odds / 100 ELSE 1 + 100 / ABS(odds) END DESC, l_suppkey, l_linenumber) AS n FROM o)
    SELECT l_orderkey, l_suppkey, odds FROM d WHERE n = 1""",
)
def best_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    price = F.when(part % 2 == 0, 100 + part % 150).otherwise(-(100 + part % 200)).cast("double")
    offers = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", price.alias("odds"))
    return market.best_price(offers, ["l_orderkey"], "odds", ["l_suppkey", "l_linenumber"]).select("l_orderkey", "l_suppkey", "odds")


@query(
    "picks_of_record",
    """WITH g AS (SELECT user_id, MAX(ts) - INTERVAL 1 DAY AS kickoff FROM events GROUP BY 1), l AS (SELECT e.user_id AS game_id, event_id, ts, ts <= kickoff - INTERVAL 2 HOUR AS ok FROM events e JOIN g USING (user_id))
    SELECT game_id, event_id, CASE WHEN ok THEN 'locked' ELSE 'late' END AS status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY ok DESC, CASE WHEN ok THEN EPOCH_US(ts) ELSE -EPOCH_US(ts) END DESC) AS n FROM l) WHERE n = 1""",
)
def picks_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("game_id"), "event_id", F.col("ts").alias("recorded_at"))
    kickoff = events.groupBy("game_id").agg((F.max("recorded_at") - F.expr("INTERVAL 24 HOURS")).alias("kickoff"))
    return market.picks_of_record(events.join(kickoff, "game_id")).select("game_id", "event_id", "status")


@query(
    "volatility_slices",
    f"""WITH {GAMES_SQL}, s AS (SELECT season, CASE WHEN ABS(spread_line) <= 1.5 THEN 'close' ELSE 'not close' END AS slice, home_margin FROM games UNION ALL SELECT season, CASE WHEN home_moneyline > 0 THEN 'home dog' ELSE 'not home dog' END, home_margin FROM games)
    SELECT slice, COUNT(*) AS n, SUM(home_margin) AS margin FROM s GROUP BY 1""",
)
def volatility_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"close": F.abs("spread_line") <= 1.5, "home dog": F.col("home_moneyline") > 0}
    return football.volatility_slices(games(spark, sf_dir), rules).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum("home_margin").alias("margin"))


@query(
    "edge_policy",
    f"""WITH {GAMES_SQL}, s AS (SELECT season, t.threshold, COUNT(*) AS bets, SUM(home_margin) / COUNT(*) AS roi FROM games JOIN (VALUES (0.5::DOUBLE), (0.6), (0.9)) AS t(threshold) ON home_win_prob > t.threshold GROUP BY 1, 2)
    SELECT season, threshold, bets, ROUND(roi, 8) AS roi, bets >= 300 AND roi > 0 AS eligible FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY (bets >= 300 AND roi > 0) DESC, roi DESC, bets DESC, threshold) AS n FROM s) WHERE n = 1""",
)
def edge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.filter(F.array(F.lit(0.5), F.lit(0.6), F.lit(0.9)), lambda t: F.col("home_win_prob") > t)
    summary = games(spark, sf_dir).withColumn("threshold", F.explode(passed)).groupBy("season", "threshold").agg(F.count(F.lit(1)).alias("bets"), F.try_divide(F.sum("home_margin"), F.count(F.lit(1))).alias("roi"))
    return rounded(market.best_policy(summary, ["season"], 300, 0.0), ["roi"])


@query(
    "signal_score",
    f"""WITH {GAMES_SQL}, r AS (SELECT game_id, (RANK() OVER (PARTITION BY season ORDER BY home_win_prob) + (COUNT(*) OVER (PARTITION BY season, home_win_prob) - 1) / 2.0::DOUBLE) / COUNT(*) OVER (PARTITION BY season) AS a,
      (RANK() OVER (PARTITION BY season ORDER BY pred_home_margin) + (COUNT(*) OVER (PARTITION BY season, pred_home_margin) - 1) / 2.0::DOUBLE) / COUNT(*) OVER (PARTITION BY season) AS b FROM games)
    SELECT game_id, ROUND((a * 0.6 + b * 0.4) / 1.0, 8) AS signal_score FROM r""",
)
def signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = market.signal_score(games(spark, sf_dir), {"home_win_prob": 0.6, "pred_home_margin": 0.4}, "season")
    return out.select("game_id", F.round("signal_score", 8).alias("signal_score"))
