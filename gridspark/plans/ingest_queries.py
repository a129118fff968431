"""Manifests and events, season tables of plays, offered lines and stitched pages, on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import lines as offered
from gridspark.operators import manifest, playbyplay
from gridspark.plans.registry import query, table
from gridspark.sources import feeds

MANIFEST_SQL = """m AS (SELECT o_orderkey AS game_id, YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, 'T' || o_custkey % 8 AS home, 'T' || (8 + o_orderkey % 8) AS away, o_orderdate::TIMESTAMP AS kickoff,
    strftime(o_orderdate, '%Y-%m') AS snapshot, CASE WHEN o_orderkey % 101 = 0 THEN 'old' END AS event_id FROM orders),
  v AS (SELECT YEAR(l_shipdate) AS season, MONTH(l_shipdate) AS week, 'T' || l_partkey % 8 AS home, 'T' || (8 + l_suppkey % 8) AS away, 'E' || l_orderkey AS event_id, l_shipdate::TIMESTAMP AS starts FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 50),
  b AS (SELECT game_id, v.event_id, ROW_NUMBER() OVER (PARTITION BY game_id ORDER BY ABS(EPOCH_US(kickoff) - EPOCH_US(starts)), v.event_id) AS i FROM m JOIN v USING (season, week, home, away)),
  e AS (SELECT m.* EXCLUDE (event_id), COALESCE(b.event_id, m.event_id) AS event_id, CASE WHEN COALESCE(b.event_id, m.event_id) IS NOT NULL THEN 'matched' WHEN (m.season, m.week) IN (SELECT (season, week) FROM v) THEN 'no_match' ELSE 'pending' END AS events_status
    FROM m LEFT JOIN b ON b.game_id = m.game_id AND b.i = 1),
  k AS (SELECT 'E' || l_orderkey AS event_id, list(DISTINCT 'm' || l_linenumber) AS found FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
  o AS (SELECT 'E' || l_orderkey AS event_id, strftime(l_shipdate, '%Y-%m') AS snapshot, list(DISTINCT 'm' || l_linenumber) AS found FROM lineitem GROUP BY 1, 2)"""


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    team = lambda n: F.concat(F.lit("T"), n.cast("string"))
    key = F.col("o_orderkey")
    games = table(spark, sf_dir, "orders").select(
        key.alias("game_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), team(F.col("o_custkey") % 8).alias("home"), team(8 + key % 8).alias("away"),
        F.col("o_orderdate").cast("timestamp").alias("kickoff"), F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"), F.when(key % 101 == 0, "old").alias("event_id"),
        F.lit("pending").alias("events_status"), F.array(F.lit("m1"), F.lit("m2")).alias("targets"),
    )
    events = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 50").select(
        F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"), team(F.col("l_partkey") % 8).alias("home"), team(8 + F.col("l_suppkey") % 8).alias("away"),
        F.concat(F.lit("E"), "l_orderkey").alias("event_id"), F.col("l_shipdate").cast("timestamp").alias("starts"),
    )
    return games, events


@query("events_to_manifest", f"WITH {MANIFEST_SQL} SELECT game_id, event_id, events_status FROM e")
def events_to_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games, the largest returned lines as the events of their month; some months have none."""
    return manifest.match_events(*_manifest(spark, sf_dir)).select("game_id", "event_id", "events_status")


@query(
    "manifest_progress",
    f"""WITH {MANIFEST_SQL}, s AS (SELECT e.game_id, e.event_id, e.snapshot, CASE WHEN e.event_id IS NULL THEN 'missing_event' WHEN k.found IS NULL THEN 'pending' WHEN list_has_any(k.found, ['m1', 'm2']) THEN 'available' ELSE 'no_target_markets' END AS markets_status
      FROM e LEFT JOIN k ON k.event_id = e.event_id)
    SELECT s.game_id, s.markets_status, CASE WHEN s.event_id IS NULL THEN 'missing_event' WHEN list_has_all(o.found, ['m1', 'm2']) THEN 'done' WHEN markets_status = 'no_target_markets' THEN 'no_target_markets' ELSE 'pending' END AS odds_status
    FROM s LEFT JOIN o ON o.event_id = s.event_id AND o.snapshot = s.snapshot""",
)
def manifest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found of each game's markets and odds so far."""
    line = table(spark, sf_dir, "lineitem")
    event, market = F.concat(F.lit("E"), "l_orderkey").alias("event_id"), F.concat(F.lit("m"), "l_linenumber").alias("market")
    known = manifest.market_status(manifest.match_events(*_manifest(spark, sf_dir)), line.filter("l_returnflag <> 'N'").select(event, market))
    out = manifest.odds_status(known, line.select(event, F.date_format("l_shipdate", "yyyy-MM").alias("snapshot"), market))
    return out.select("game_id", "markets_status", "odds_status")


#: Columns of the play-by-play frame, in Spark and in SQL alike, made of lines.
PLAY_COLUMNS = {
    "season": "CAST(YEAR(l_shipdate) AS INT)", "game_id": "l_orderkey", "posteam": "CASE WHEN l_linenumber <> 7 THEN l_suppkey % 32 END", "defteam": "CASE WHEN l_quantity <> 50 THEN (l_suppkey + l_linenumber) % 33 END",
    "pass_attempt": "CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END", "rush_attempt": "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 1 ELSE 0 END", "yards_gained": "l_quantity - 20",
    "passing_yards": "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity - 21 END", "rushing_yards": "CASE WHEN l_linenumber % 2 = 1 THEN l_quantity - 22 END", "complete_pass": "CASE WHEN l_tax < 0.05 THEN 1 ELSE 0 END",
    "pass_touchdown": "CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END", "interception": "CASE WHEN l_partkey % 17 = 0 THEN 1 END", "sack": "CASE WHEN l_tax >= 0.08 THEN 1 ELSE 0 END", "air_yards": "l_linenumber", "yards_after_catch": "l_linenumber * 2",
    "rush_touchdown": "CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE 0 END", "tackled_for_loss": "CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END", "qb_hit": "CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END",
    "success": "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END", "epa": "l_quantity - 25", "first_down_pass": "CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END", "first_down_rush": "CASE WHEN l_quantity > 35 THEN 1 ELSE 0 END",
    "fumble_forced": "CASE WHEN l_partkey % 23 = 0 THEN 1 ELSE 0 END", "return_touchdown": "CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END", "fumble_recovery_1_team": "CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 33 END",
    "fumble_recovery_2_team": "l_partkey % 33", "home_score": "CASE WHEN l_linenumber <> 3 THEN l_quantity END", "away_score": "CASE WHEN l_returnflag <> 'A' THEN l_linenumber * 7 END",
}
_N = "COALESCE({}, 0)".format
_LOSS = f"GREATEST(-{_N('yards_gained')}, 0)"
_PASS, _RUN = f"{_N('pass_attempt')} > 0", f"{_N('rush_attempt')} > 0"
_PASSED = f"CASE WHEN {_PASS} THEN COALESCE(passing_yards, yards_gained, 0) ELSE 0 END"
_RAN = f"CASE WHEN {_RUN} THEN COALESCE(rushing_yards, yards_gained, 0) ELSE 0 END"
_TFL = f"CASE WHEN {_RUN} THEN {_N('tackled_for_loss')} ELSE 0 END"
OFFENCE_SQL = {
    "passing_attempts": _N("pass_attempt"), "passing_completions": _N("complete_pass"), "passing_yards": _PASSED, "passing_touchdowns": _N("pass_touchdown"), "passing_interceptions": _N("interception"),
    "passing_sacks": _N("sack"), "passing_sack_yards": f"CASE WHEN {_N('sack')} > 0 THEN {_LOSS} ELSE 0 END", "passing_air_yards": f"CASE WHEN {_PASS} THEN {_N('air_yards')} ELSE 0 END",
    "passing_yards_after_catch": f"CASE WHEN {_PASS} THEN {_N('yards_after_catch')} ELSE 0 END", "rushing_attempts": _N("rush_attempt"), "rushing_yards": _RAN, "rushing_touchdowns": _N("rush_touchdown"),
    "rushing_tlost": _TFL, "rushing_tlost_yards": f"CASE WHEN {_TFL} > 0 THEN {_LOSS} ELSE 0 END", "passing_first_downs": _N("first_down_pass"), "rushing_first_downs": _N("first_down_rush"),
    "offense_successful_plays": f"CASE WHEN {_PASS} OR {_RUN} THEN {_N('success')} ELSE 0 END", "offense_epa": _N("epa"), "offense_plays": f"{_N('pass_attempt')} + {_N('rush_attempt')}", "offense_yards": f"{_PASSED} + {_RAN}",
}
DEFENCE_SQL = {
    "defense_sacks": _N("sack"), "defense_qb_hits": _N("qb_hit"), "defense_interceptions": _N("interception"), "defense_forced_fumbles": _N("fumble_forced"),
    "defense_fumble_recoveries": "(COALESCE(fumble_recovery_1_team = team, FALSE))::INT + (COALESCE(fumble_recovery_2_team = team, FALSE))::INT", "defense_tloss": _N("tackled_for_loss"),
    "defense_tloss_yards": f"CASE WHEN {_N('tackled_for_loss')} > 0 THEN {_LOSS} ELSE 0 END", "defense_touchdowns": _N("return_touchdown"),
}
SHARES_SQL = {
    "passing_cmp_pct": "passing_completions_sum / NULLIF(passing_attempts_sum, 0)", "passing_avg_yards": "passing_yards_sum / NULLIF(passing_attempts_sum, 0)", "rushing_avg_yards": "rushing_yards_sum / NULLIF(rushing_attempts_sum, 0)",
    "offense_pass_rate": "passing_attempts_sum / NULLIF(offense_plays_sum, 0)", "offense_success_rate": "offense_successful_plays_sum / NULLIF(offense_plays_sum, 0)", "offense_epa_per_play": "offense_epa_sum / NULLIF(offense_plays_sum, 0)",
}
PLAYS_SQL = "p AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in PLAY_COLUMNS.items()) + " FROM lineitem)"


def _season_sql() -> str:
    sums = lambda names: ", ".join(f"SUM({v})::DOUBLE AS {n}_sum" for n, v in names.items())
    names = [*OFFENCE_SQL, *DEFENCE_SQL]
    shown = ", ".join([f"ROUND({n}_sum, 6) AS {n}_sum, ROUND({n}_sum / games, 8) AS {n}_mean" for n in names] + [f"ROUND({v}, 8) AS {n}" for n, v in SHARES_SQL.items()])
    return f"""WITH {PLAYS_SQL}, a AS (SELECT season, posteam AS team, COUNT(DISTINCT game_id) AS g, {sums(OFFENCE_SQL)} FROM p WHERE posteam IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT season, defteam AS team, COUNT(DISTINCT game_id) AS g, {sums(DEFENCE_SQL)} FROM (SELECT *, defteam AS team FROM p) WHERE defteam IS NOT NULL GROUP BY 1, 2),
    j AS (SELECT season, team, COALESCE(a.g, 0) + COALESCE(d.g, 0) AS games, a.* EXCLUDE (season, team, g), d.* EXCLUDE (season, team, g) FROM a FULL JOIN d USING (season, team))
    SELECT season, team, games::BIGINT AS games, {shown} FROM j"""


def _plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in PLAY_COLUMNS.items()])


@query("season_team_table", _season_sql())
def season_team_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as plays of an offence against a defence; every total, mean and share of the library's list."""
    totals, shares = playbyplay.offence_and_defence()
    out = playbyplay.season_table(_plays(spark, sf_dir), totals, shares, ["season"], {"offence": "posteam", "defence": "defteam"}, "game_id")
    kept = {c: F.round(c, 6 if c.endswith("_sum") else 8) for c in out.columns if c not in ("season", "team", "games")}
    return out.withColumns(kept)


@query("scores_from_plays", f"WITH {PLAYS_SQL} SELECT game_id, MAX(home_score)::DOUBLE AS home_score, MAX(away_score)::DOUBLE AS away_score FROM p GROUP BY 1 HAVING MAX(home_score) IS NOT NULL AND MAX(away_score) IS NOT NULL")
def scores_from_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return playbyplay.game_scores(_plays(spark, sf_dir))


@query(
    "feed_stat_table",
    """WITH x AS (SELECT YEAR(o_orderdate) AS season, o_custkey % 32 AS team, LOWER(o_orderstatus) AS category, FLOOR(o_totalprice / 100)::BIGINT AS a, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 END AS b FROM orders),
    l AS (SELECT season, team, category || '_' || unnest(['a', 'b']) AS stat, unnest([a, b])::DOUBLE AS v FROM x)
    SELECT season, team, stat, ROUND(AVG(v), 6) AS mean, SUM(v) AS total, COUNT(v) AS n FROM l WHERE v IS NOT NULL GROUP BY 1, 2, 3""",
)
def feed_stat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of statistics as JSON, with texts and nulls among them."""
    key = F.col("o_orderkey")
    payload = F.to_json(F.struct(F.floor(F.col("o_totalprice") / 100).alias("a"), F.when(key % 3 > 0, key % 7).alias("b"), F.lit("n/a").alias("c")))
    stats = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), (F.col("o_custkey") % 32).alias("team"), F.lower("o_orderstatus").alias("category"), payload.alias("stats"))
    return playbyplay.stat_table(stats, ["season", "team"], "category", "stats").withColumn("mean", F.round("mean", 6))


FIRST, LAST = ("Al", "Alan", "Bo", "Cy", "Abel", "Bob", "Cyd"), ("Stone", "Reed", "Moss", "Hill", "Ford")
TEAMS = ("BUF", "KC", "JAC", "SF", "WSH", "DAL")
_NAME = f"({list(FIRST)})[1 + l_partkey % 7] || ' ' || ({list(LAST)})[1 + l_partkey % 5]"
_INITIAL, _PREFIX = "LOWER(name[1]) || ':' || LOWER(split_part(name, ' ', 2))", "LOWER(name[1:2]) || ':' || LOWER(split_part(name, ' ', 2))"
_GAME = f"YEAR(l_shipdate) || '_' || MONTH(l_shipdate) || '_' || ({list(TEAMS)})[1 + l_suppkey % 3] || '_' || ({list(TEAMS)})[4 + l_suppkey % 3]"
_NORMAL = "CASE t WHEN 'JAC' THEN 'JAX' WHEN 'WSH' THEN 'WAS' ELSE t END"
_MARKET = "CASE WHEN l_linenumber % 4 = 0 THEN 'anytime_td' WHEN l_linenumber % 4 = 1 THEN 'rush_yards' ELSE 'rec_yards' END"
LINES_SQL = f"""b AS (SELECT *, YEAR(l_shipdate) AS season, MONTH(l_shipdate) AS week, {_GAME} AS game_id, {_MARKET} AS market, {_NAME} AS name, (['AIR', 'RAIL', 'MAIL', 'SHIP'])[1 + l_orderkey % 4] AS mode FROM lineitem),
  l0 AS (SELECT season, week, game_id, market, LOWER(mode) AS sportsbook, name, l_quantity::DOUBLE AS line, l_linestatus = 'O' AS comparable, CASE WHEN l_tax < 0.06 THEN -100 - l_partkey % 50 END::DOUBLE AS over_odds,
    (100 + l_suppkey % 40)::DOUBLE AS under_odds, {_INITIAL} AS name_key, {_PREFIX} AS prefix_key FROM b WHERE mode IN ('AIR', 'RAIL')),
  l AS (SELECT *, md5(concat_ws('|', season, week, game_id, market, name_key, sportsbook, line)) AS d FROM l0),
  lines AS (SELECT *, d || ':' || ROW_NUMBER() OVER (PARTITION BY d ORDER BY name, comparable NULLS FIRST, over_odds NULLS FIRST, under_odds NULLS FIRST, prefix_key) AS line_id FROM l),
  p0 AS (SELECT season, week, game_id, market, 'P' || l_partkey % 210 AS player_id, name, l_extendedprice / 2000 AS projection, l_quantity::DOUBLE AS actual, ROW_NUMBER() OVER (PARTITION BY season, week, game_id, market, l_partkey % 210 ORDER BY l_orderkey DESC, l_linenumber DESC) AS i
    FROM b WHERE mode NOT IN ('AIR', 'RAIL')), p AS (SELECT *, {_INITIAL} AS name_key, {_PREFIX} AS prefix_key FROM p0 WHERE i = 1),
  i0 AS (SELECT season, week, {_NORMAL.replace(' t ', ' t ')} AS team, name, l_partkey % 210 AS player, {_INITIAL} AS name_key, {_PREFIX} AS prefix_key FROM (SELECT *, ({list(TEAMS)})[1 + l_suppkey % 3] AS t FROM b WHERE mode = 'MAIL')),
  i AS (SELECT season, week, team, name_key, prefix_key, MIN('P' || player) AS identity_id FROM i0 GROUP BY ALL HAVING COUNT(DISTINCT player) = 1),
  c AS (SELECT line_id, season, week, game_id, market, name_key, prefix_key, unnest([split_part(game_id, '_', 3), split_part(game_id, '_', 4)]) AS t FROM lines),
  s AS (SELECT line_id, MIN(identity_id) AS pid FROM (SELECT c.*, {_NORMAL} AS team FROM c) c JOIN i USING (season, week, team, name_key, prefix_key) JOIN p ON p.season = c.season AND p.week = c.week AND p.game_id = c.game_id AND p.market = c.market AND p.player_id = i.identity_id
    GROUP BY 1 HAVING COUNT(DISTINCT identity_id) = 1),
  x AS (SELECT line_id, MIN(player_id) AS pid FROM lines JOIN p USING (season, week, game_id, market, name_key, prefix_key) GROUP BY 1),
  r AS (SELECT lines.*, s.pid AS p1, x.pid AS p2 FROM lines LEFT JOIN s USING (line_id) LEFT JOIN x USING (line_id)),
  u AS (SELECT season, week, game_id, market, name_key, COUNT(DISTINCT prefix_key) AS prefixes FROM r WHERE p1 IS NULL AND p2 IS NULL GROUP BY ALL),
  w AS (SELECT season, week, game_id, market, name_key, COUNT(*) AS people, MIN(player_id) AS only_id FROM p GROUP BY ALL), g AS (SELECT season, week, game_id, market, COUNT(*) AS n FROM p GROUP BY ALL),
  k AS (SELECT r.*, prefixes, people, only_id, n, p1 IS NULL AND p2 IS NULL AND market <> 'anytime_td' AND prefixes <= 1 AND COALESCE(people, 0) = 1 AS third FROM r LEFT JOIN u USING (season, week, game_id, market, name_key) LEFT JOIN w USING (season, week, game_id, market, name_key)
    LEFT JOIN g USING (season, week, game_id, market)),
  f AS (SELECT k.*, CASE WHEN p1 IS NOT NULL THEN 'identity_strict' WHEN p2 IS NOT NULL THEN 'strict_prefix' WHEN third THEN 'initial_last_unique' END AS match_method, COALESCE(p1, p2, CASE WHEN third THEN only_id END) AS player_id FROM k),
  z AS (SELECT f.*, p.projection, p.actual, CASE WHEN match_method IS NOT NULL THEN NULL WHEN n IS NULL THEN 'no_prediction' WHEN people IS NULL THEN 'no_such_name' WHEN f.market = 'anytime_td' THEN 'strict_market' WHEN people > 1 THEN 'several_players' ELSE 'several_lines' END AS reason
    FROM f LEFT JOIN p ON p.season = f.season AND p.week = f.week AND p.game_id = f.game_id AND p.market = f.market AND p.player_id = f.player_id)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    part, supp, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    year, month = F.year("l_shipdate"), F.month("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(
        "*", year.alias("season"), month.alias("week"), F.concat_ws("_", year, month, pick(TEAMS[:3], supp % 3), pick(TEAMS[3:], supp % 3)).alias("game_id"),
        F.when(n % 4 == 0, "anytime_td").when(n % 4 == 1, "rush_yards").otherwise("rec_yards").alias("market"), F.concat_ws(" ", pick(FIRST, part % 7), pick(LAST, part % 5)).alias("player_name"),
        pick(("AIR", "RAIL", "MAIL", "SHIP"), F.col("l_orderkey") % 4).alias("mode"),
    )
    book = F.concat(F.lit(" "), F.col("mode"))
    lines = rows.select(
        *offered.GAME, book.alias("sportsbook"), "player_name", F.col("l_quantity").alias("line"), (F.col("l_linestatus") == "O").alias("comparable"),
        F.when(F.col("l_tax") < 0.06, -100 - part % 50).cast("double").alias("over_odds"), (100 + supp % 40).cast("double").alias("under_odds"),
    )
    person = F.concat(F.lit("P"), (part % 210).cast("string"))
    predictions = rows.filter("mode NOT IN ('AIR', 'RAIL')").select(
        *offered.GAME, person.alias("player_id"), "player_name", (F.col("l_extendedprice") / 2000).alias("projection"), F.col("l_quantity").cast("double").alias("actual"), (F.col("l_orderkey") * 10 + n).alias("order")
    )
    from gridspark.functions import teams

    named = rows.filter("mode = 'MAIL'").select("season", "week", pick(TEAMS[:3], supp % 3).alias("team"), "player_name", person.alias("player_id")).distinct()
    known = offered.with_name_keys(named).select(
        "season", "week", teams.abbreviation(F.col("team")).alias("team"), "name_key", "prefix_key", "player_id", F.col("player_name").alias("alias"), F.lit(1.0).alias("confidence")
    )
    return offered.match_lines(offered.prepare_lines(lines, ["AIR", "rail "]), offered.prepare_predictions(predictions, "order"), known)


@query("offered_line_matches", f"WITH {LINES_SQL} SELECT line_id, match_method, reason, player_id, ROUND(projection, 6) AS projection, actual FROM z")
def offered_line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two books against the projections made of the other lines; every line with how it was matched or why not."""
    return _matched(spark, sf_dir).select("line_id", "match_method", "reason", "player_id", F.round("projection", 6).alias("projection"), "actual")


@query(
    "offered_line_summary",
    f"""WITH {LINES_SQL}, q AS (SELECT *, match_method IS NOT NULL AS hit, projection - line AS edge FROM z), v AS (SELECT *, CASE WHEN NOT hit OR actual = line OR edge = 0 THEN NULL WHEN edge > 0 THEN actual > line ELSE actual < line END AS ok FROM q)
    SELECT COALESCE(market, 'all') AS market, COALESCE(sportsbook, 'all') AS sportsbook, COUNT(*) AS lines, COUNT(*) FILTER (WHERE hit) AS matched, ROUND(COUNT(*) FILTER (WHERE hit) / COUNT(*)::DOUBLE, 8) AS matched_rate,
      {', '.join(f"COUNT(*) FILTER (WHERE match_method = '{m}') AS {m}" for m in ("identity_strict", "strict_prefix", "initial_last_unique"))},
      {', '.join(f"COUNT(*) FILTER (WHERE reason = '{r}') AS {r}" for r in ("no_prediction", "no_such_name", "strict_market", "several_players", "several_lines"))},
      COUNT(DISTINCT CASE WHEN hit THEN game_id END) AS games, COUNT(DISTINCT player_id) AS players, COUNT(*) FILTER (WHERE hit AND comparable) AS comparable_rows, COUNT(*) FILTER (WHERE hit AND over_odds IS NOT NULL AND under_odds IS NOT NULL) AS two_way_rows,
      COUNT(ok) AS picks, ROUND(AVG(ok::INT), 8) AS pick_accuracy, ROUND(AVG(CASE WHEN hit THEN (actual > line)::INT END), 8) AS over_rate, ROUND(AVG(CASE WHEN hit THEN edge END), 5) AS mean_edge,
      ROUND(AVG(CASE WHEN hit THEN ABS(projection - actual) END), 5) AS model_mae, ROUND(AVG(CASE WHEN hit THEN ABS(line - actual) END), 5) AS line_mae
    FROM v GROUP BY GROUPING SETS ((), (market), (sportsbook))""",
)
def offered_line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all, by market and by book; the methods and the reasons add up to the lines."""
    out = offered.join_summary(_matched(spark, sf_dir))
    places = {"matched_rate": 8, "pick_accuracy": 8, "over_rate": 8, "mean_edge": 5, "model_mae": 5, "line_mae": 5}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


STITCH_SQL = """c AS (SELECT c_nationkey, c_custkey, c_mktsegment, c_acctbal, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer)"""


@query(
    "stitched_player_tables",
    f"WITH {STITCH_SQL} SELECT c_nationkey AS page, r::INT AS \"row\", 'C' || c_custkey AS player, unnest(['seg', 'bal', 'bal_1']) AS name, unnest([c_mktsegment, c_acctbal::DECIMAL(18, 2)::VARCHAR, (c_custkey % 7)::VARCHAR]) AS value FROM c",
)
def stitched_player_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per nation: names in one table, values in another, with header rows in other places."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("b")))).alias("c"))
    cell = lambda *parts: F.concat(*[F.concat(F.lit("<td>"), p, F.lit("</td>")) for p in parts])
    line = lambda parts: F.concat(F.lit("<tr>"), parts, F.lit("</tr>"))
    head = F.lit("<tr><th> Seg </th><th colspan=2>Bal.</th></tr>")
    names = F.transform("c", lambda x, i: F.concat(F.when(i % 10 == 0, "<tr><th>Player</th></tr>").otherwise(""), line(cell(F.concat(F.lit("<b>C"), x["c_custkey"], F.lit("</b>"))))))
    values = F.transform("c", lambda x, i: F.concat(F.when(i % 7 == 3, head).otherwise(F.lit("")), line(cell(x["c_mktsegment"], x["b"], (x["c_custkey"] % 7).cast("string")))))
    html = F.concat(F.lit("<table>"), F.array_join(names, "\n"), F.lit("</table><p>x</p><table class='v'>"), head, F.array_join(values, ""), F.lit("</table>"))
    return feeds.stitched_tables(rows.select("page", html.alias("html")), "html", ["player"])


@query(
    "paged_player_totals",
    """WITH x AS (SELECT YEAR(l_shipdate) AS season, l_returnflag AS category, 1 + l_linenumber % 6 AS page, l_suppkey % 20 AS team, l_partkey AS player, CASE WHEN l_tax > 0 THEN l_quantity::INT::VARCHAR ELSE '--' END AS yds, l_orderkey, l_linenumber FROM lineitem),
    y AS (SELECT *, RANK() OVER (PARTITION BY season, category, player ORDER BY page) = 1 AS fresh FROM x),
    p AS (SELECT season, category, page, BOOL_OR(fresh) AS f FROM y GROUP BY 1, 2, 3), g AS (SELECT *, BOOL_AND(f) OVER w AND ROW_NUMBER() OVER w = page AS ok FROM p WINDOW w AS (PARTITION BY season, category ORDER BY page)),
    k AS (SELECT season, category, page FROM (SELECT *, BOOL_AND(ok) OVER (PARTITION BY season, category ORDER BY page) AS good FROM g) WHERE good),
    v AS (SELECT y.season, y.team, y.category, y.page, SUM(TRY_CAST(yds AS DOUBLE)) AS total FROM y JOIN k USING (season, category, page) WHERE fresh GROUP BY ALL)
    SELECT season, team, LOWER('espn_' || category || '_yds') AS stat, arg_min(total, page) FILTER (WHERE total IS NOT NULL) AS total FROM v GROUP BY 1, 2, 3""",
)
def paged_player_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows of pages, with players that come again on later pages; per team the totals of the first page that has them."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.col("l_returnflag").alias("category"), (1 + F.col("l_linenumber") % 6).alias("page"), (F.col("l_suppkey") % 20).alias("team"), F.col("l_partkey").alias("player"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("int").cast("string")).otherwise("--").alias("value"),
    )
    kept = feeds.paged(rows, ["season", "category"], "page", ["player"])
    return feeds.team_totals(kept.withColumns({"name": F.lit("yds"), "source": F.col("page")}), ["season", "team"], "category")


@query(
    "feed_player_prices",
    """SELECT o_orderstatus AS feed, o_orderkey AS id, o_orderkey // 10 AS game_id, o_custkey AS player_id, CASE WHEN o_custkey % 2 = 0 THEN 'dk' ELSE 'fd' END AS vendor, o_orderpriority AS prop_type, CASE WHEN o_custkey % 9 > 0 THEN FLOOR(o_totalprice / 1000) + 0.5 END AS line,
      CASE WHEN o_custkey % 3 = 0 THEN 'milestone' ELSE 'over_under' END AS market_type, (-110 - o_custkey % 20)::INT AS over_odds, CASE WHEN o_custkey % 3 > 0 THEN (100 + o_custkey % 20)::INT END AS under_odds FROM orders""",
)
def feed_player_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per customer and status, some a list and some an object that holds it; broken lines are null."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    one, two = (-110 - cust % 20).cast("int"), (100 + cust % 20).cast("int")
    single = cust % 3 == 0
    market = F.struct(
        F.when(single, "milestone").otherwise("over_under").alias("type"), F.when(single, one).alias("odds"), F.when(~single, one).alias("over_odds"), F.when(~single, two).alias("under_odds")
    )
    line = F.when(cust % 9 > 0, (F.floor(F.col("o_totalprice") / 1000) + 0.5).cast("string")).otherwise("n/a")
    record = F.struct(
        key.alias("id"), F.floor(key / 10).alias("game_id"), cust.alias("player_id"), F.when(cust % 2 == 0, "dk").otherwise("fd").alias("vendor"), F.col("o_orderpriority").alias("prop_type"), line.alias("line_value"), market.alias("market"), F.lit("x").alias("other")
    )
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("feed")).agg(F.collect_list(record).alias("data"))
    payload = F.when(F.col("o_custkey") % 2 == 0, F.to_json("data")).otherwise(F.to_json(F.struct("data")))
    return feeds.player_prices(rows.select("feed", payload.alias("payload")))


@query(
    "feed_numbered_players",
    f"WITH {STITCH_SQL} SELECT c_nationkey AS page, r::INT AS position, c_custkey::VARCHAR AS player_id, c_mktsegment AS name, (c_custkey % 7)::VARCHAR AS team FROM c",
)
def feed_numbered_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per nation whose records lie under numbers beside their count."""
    record = F.to_json(F.struct(F.array(F.struct(F.col("x.c_custkey").cast("string").alias("player_id"), F.struct(F.col("x.c_mktsegment").alias("full")).alias("name"), (F.col("x.c_custkey") % 7).alias("team"))).alias("player")))
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("page")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("c"))
    each = rows.select("page", F.posexplode("c").alias("i", "x")).select("page", F.concat(F.lit('"'), F.col("i").cast("string"), F.lit('":'), record).alias("one"))
    body = each.groupBy("page").agg(F.concat(F.lit('{"fantasy_content":{"players":{'), F.array_join(F.collect_list("one"), ","), F.lit(',"count":'), F.count(F.lit(1)).cast("string"), F.lit("}}}")).alias("payload"))
    return feeds.numbered(body, "players", {"player_id": "$.player[0].player_id", "name": "$.player[0].name.full", "team": "$.player[0].team"})
