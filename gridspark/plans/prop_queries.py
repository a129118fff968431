"""Players' markets on order lines: a line is a player's value in a game, lines still open are players to be projected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import odds
from gridspark.operators import overs, props
from gridspark.plans.aggregate_queries import BETS_SQL, graded
from gridspark.plans.registry import query, table

TEAMS = ["BUF", "KC", "JAX", "SF", "WAS", "DAL"]
MARKETS = ["qb_passing_tds", "rb_rushing_yards", "wrte_receiving_yards", "anytime_td"]
ROWS_SQL = f"""b AS (SELECT *, YEAR(l_shipdate) AS season, MONTH(l_shipdate) AS week, ({TEAMS})[1 + l_suppkey % 6] AS team, ({TEAMS})[1 + (l_suppkey + l_partkey) % 6] AS opponent, 'P' || l_partkey % 400 AS player_id,
    ({[*MARKETS, "bogus"]})[1 + l_partkey % 5] AS market, CASE WHEN l_tax > 0 THEN l_quantity - 10 END::DOUBLE AS v, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey * 100 + l_suppkey % 100 AS ord FROM lineitem),
  r AS (SELECT *, season || '_' || week || '_' || CASE WHEN l_linenumber % 2 = 1 THEN opponent || '_' || team ELSE team || '_' || opponent END AS game_id FROM b WHERE team <> opponent AND market <> 'bogus'),
  l AS (SELECT season, week, game_id, team, opponent, player_id, market, v, l_extendedprice / 2000 AS proj, (l_suppkey % 90 + 5) / 100.0::DOUBLE AS p0, ord FROM r WHERE l_linestatus = 'F' AND v IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY season, week, game_id, team, player_id, market ORDER BY ord DESC) = 1),
  c AS (SELECT season, week, game_id, team, opponent, player_id, market FROM r WHERE l_linestatus = 'O' QUALIFY ROW_NUMBER() OVER (PARTITION BY season, week, game_id, team, player_id, market ORDER BY ord DESC) = 1)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    part, supp, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    team, other = pick(TEAMS, supp % 6), pick(TEAMS, (supp + part) % 6)
    year, month = F.year("l_shipdate"), F.month("l_shipdate")
    game = F.when(n % 2 == 1, F.concat_ws("_", year, month, other, team)).otherwise(F.concat_ws("_", year, month, team, other))
    return table(spark, sf_dir, "lineitem").select(
        year.alias("season"), month.alias("week"), game.alias("game_id"), team.alias("team"), other.alias("opponent"), F.concat(F.lit(" P"), (part % 400).cast("string")).alias("player_id"),
        F.upper(pick([*MARKETS, "bogus"], part % 5)).alias("market"), F.when(F.col("l_tax") > 0, F.col("l_quantity") - 10).cast("double").alias("actual_value"), (F.col("l_extendedprice") / 2000).alias("model_projection"),
        ((supp % 90 + 5) / 100.0).alias("prob_over_zero"), ((F.col("l_orderkey") * 10 + n) * 1000000 + part * 100 + supp % 100).alias("ord"), "l_linestatus",
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.prepare_labels(_lines(spark, sf_dir).filter("l_linestatus = 'F'"), MARKETS, "ord").drop("l_linestatus")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).filter("l_linestatus = 'O'").drop("actual_value", "l_linestatus")
    return props.prepare_candidates(rows, MARKETS, "ord")


HISTORY = {
    "player_games_prior": "ROW_NUMBER() OVER w - 1", "player_avg_prior": "AVG(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "player_std_prior": "STDDEV_SAMP(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "player_last1_value": "LAG(v) OVER w", "player_last3_avg": "AVG(v) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", "player_last5_avg": "AVG(v) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)",
    "player_over_zero_rate_prior": "AVG(z::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "player_season_games_prior": "ROW_NUMBER() OVER s - 1",
    "player_season_avg_prior": "AVG(v) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "player_season_last3_avg": "AVG(v) OVER (s ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
}
CONTEXT = {
    "weekly_total_avg_prior": "AVG(total) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "weekly_total_last3_avg": "AVG(total) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
    "weekly_mean_avg_prior": "AVG(m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "weekly_mean_last3_avg": "AVG(m) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
    "players_avg_prior": "AVG(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
}
NUMBERS = [*HISTORY, *(f"{p}_{c}" for p in ("team_market", "opponent_allowed") for c in CONTEXT)]


def _features_sql(rows: str, where: str) -> str:
    context = ", ".join(
        f"{e}_w AS (SELECT season, week, {e}, market, COALESCE(SUM(v), 0) AS total, AVG(v) AS m, COUNT(DISTINCT player_id) AS n FROM a GROUP BY 1, 2, 3, 4), "
        f"{e}_c AS (SELECT season, week, {e}, market, {', '.join(f'{x} AS {p}_{c}' for c, x in CONTEXT.items())} FROM {e}_w WINDOW w AS (PARTITION BY {e}, market ORDER BY season, week))"
        for e, p in (("team", "team_market"), ("opponent", "opponent_allowed"))
    )
    return f"""WITH {ROWS_SQL}, a AS ({rows}), h AS (SELECT a.*, {', '.join(f'{x} AS {c}' for c, x in HISTORY.items())} FROM a
      WINDOW w AS (PARTITION BY player_id, market ORDER BY season, week, game_id, team, asked), s AS (PARTITION BY season, player_id, market ORDER BY week, game_id, team, asked)), {context}
    SELECT season, week, game_id, team, player_id, market, {', '.join(f'ROUND({c}, 6) AS {c}' for c in NUMBERS)}, split_part(game_id, '_', 4) = team AS is_home, split_part(game_id, '_', 3) = team AS is_away
    FROM h LEFT JOIN team_c USING (season, week, team, market) LEFT JOIN opponent_c USING (season, week, opponent, market) {where}"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*props.KEYS, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in NUMBERS], "is_home", "is_away")


@query("weekly_prop_context", _features_sql("SELECT season, week, game_id, team, opponent, player_id, market, v, v > 0 AS z, FALSE AS asked FROM l", ""))
def weekly_prop_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of players, and context of teams and opponents, before each label."""
    return _shown(props.features(_labels(spark, sf_dir)))


@query(
    "prop_candidate_features",
    _features_sql("SELECT season, week, game_id, team, opponent, player_id, market, v, v > 0 AS z, FALSE AS asked FROM l UNION ALL SELECT season, week, game_id, team, opponent, player_id, market, NULL, FALSE, TRUE FROM c", "WHERE asked"),
)
def prop_candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for players to be projected, who have no value yet."""
    return _shown(props.features(_labels(spark, sf_dir), _candidates(spark, sf_dir)))


def _auc_sql(rows: str, p: str, y: str, keys: list[str]) -> str:
    """The area under the ROC curve by ``keys`` as a table expression."""
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"""(SELECT {k}SUM(pos * (below + (n - pos) / 2.0)) / NULLIF(SUM(pos) * SUM(n - pos), 0) AS auc FROM (SELECT *, COALESCE(SUM(n - pos) OVER ({part}ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {k}{p} AS q, SUM({y}::INT) AS pos, COUNT(*) AS n FROM {rows} WHERE {p} IS NOT NULL GROUP BY ALL)) {'GROUP BY ' + ', '.join(keys) if keys else ''})"""


def _score_sql(p: str, y: str, brier: str, loss: str) -> str:
    q = f"CASE WHEN {p} IS NOT NULL THEN GREATEST(1e-6, LEAST(1 - 1e-6, {p})) END"
    return f"ROUND(AVG(({q} - {y}::INT) ** 2), 10) AS {brier}, ROUND(AVG(-({y}::INT * LN({q}) + (1 - {y}::INT) * LN(1 - {q}))), 9) AS {loss}"


def _places(name: str) -> int:
    """Digits that are compared: means of few decimals would end in a tie at fewer."""
    return 10 if "brier" in name else 9 if "logloss" in name else 7


METHODS = ("residual_cdf", "market_residual_blend", "market_implied_fallback", "base_rate_fallback")


@query(
    "over_probability_summary",
    f"""WITH {BETS_SQL}, g AS (SELECT *, CASE WHEN l_partkey % 11 > 0 THEN CASE WHEN odds > 0 THEN 100 / (odds + 100) ELSE ABS(odds) / (ABS(odds) + 100) END END AS mp, l_linenumber - 4 AS edge, ({list(METHODS)})[1 + l_linenumber % 4] AS method FROM graded),
    s AS (SELECT COALESCE(market, 'all') AS market, COUNT(*) AS n, ROUND(AVG(won::INT), 7) AS actual_over_rate, {_score_sql('p', 'won', 'model_brier', 'model_logloss')}, ROUND(AVG(((p >= 0.5) = won)::INT), 7) AS model_pick_accuracy,
      {_score_sql('mp', 'won', 'market_brier', 'market_logloss')}, ROUND(AVG(((mp >= 0.5) = won)::INT), 7) AS market_pick_accuracy, ROUND(AVG(CASE WHEN edge <> 0 THEN ((edge > 0) = won)::INT END), 7) AS projection_pick_accuracy,
      ROUND(AVG(p), 7) AS mean_prob_over_model, ROUND(AVG(mp), 7) AS mean_prob_over_market, ROUND(AVG(p - mp), 7) AS mean_prob_edge, {', '.join(f"COUNT(*) FILTER (WHERE method = '{m}') AS {m}_rows" for m in METHODS)} FROM g GROUP BY GROUPING SETS ((), (market))),
    a AS (SELECT 'all' AS market, auc AS x FROM {_auc_sql('g', 'p', 'won', [])} UNION ALL SELECT * FROM {_auc_sql('g', 'p', 'won', ['market'])}), b AS (SELECT 'all' AS market, auc AS y FROM {_auc_sql('g', 'mp', 'won', [])} UNION ALL SELECT * FROM {_auc_sql('g', 'mp', 'won', ['market'])})
    SELECT s.*, ROUND(x, 7) AS model_auc, ROUND(y, 7) AS market_auc FROM s JOIN a USING (market) JOIN b USING (market)""",
)
def over_probability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets as lines gone over, some without a price."""
    n = F.col("l_linenumber")
    rows = graded(spark, sf_dir).withColumns({
        "prob_over_model": F.col("p"), "prob_over_market": F.when(F.col("l_partkey") % 11 > 0, odds.american_to_implied(F.col("odds"))), "actual_over_line": F.col("won"), "model_edge": n - 4,
        "method": F.element_at(F.array(*[F.lit(m) for m in METHODS]), (n % 4 + 1).cast("int")),
    })
    out = props.over_probability_summary(rows)
    return out.withColumns({c: F.round(c, _places(c)) for c, kind in out.dtypes if kind == "double"})


@query(
    "confidence_tier_metrics",
    f"""WITH {ROWS_SQL}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id, market ORDER BY season, week, game_id, team) - 1 AS prior FROM l),
    t AS (SELECT *, CASE WHEN market <> 'anytime_td' THEN prior WHEN week > 6 THEN 7 ELSE 0 END AS size, v > 0 AS z FROM k), u AS (SELECT *, CASE WHEN size >= 20 THEN 'high' WHEN size >= 5 THEN 'medium' ELSE 'low' END AS confidence_tier FROM t),
    s AS (SELECT COALESCE(market, 'all') AS market, COALESCE(confidence_tier, 'all') AS confidence_tier, COUNT(*) AS n_rows, ROUND(AVG(size), 6) AS avg_sample_size, MIN(size)::INT AS min_sample_size, MAX(size)::INT AS max_sample_size, ROUND(AVG(ABS(proj - v)), 6) AS mae,
      ROUND(SQRT(AVG((proj - v) ** 2)), 6) AS rmse, {_score_sql('p0', 'z', 'brier_over_zero', 'logloss_over_zero')}, ROUND(AVG(z::INT), 7) AS actual_over_zero_rate, ROUND(AVG(p0), 10) AS prob_over_zero_mean FROM u GROUP BY GROUPING SETS ((), (confidence_tier), (market), (market, confidence_tier))),
    a AS (SELECT 'all' AS market, 'all' AS confidence_tier, auc FROM {_auc_sql('u', 'p0', 'z', [])} UNION ALL SELECT 'all', confidence_tier, auc FROM {_auc_sql('u', 'p0', 'z', ['confidence_tier'])} UNION ALL SELECT market, 'all', auc FROM {_auc_sql('u', 'p0', 'z', ['market'])}
      UNION ALL SELECT market, confidence_tier, auc FROM {_auc_sql('u', 'p0', 'z', ['market', 'confidence_tier'])})
    SELECT s.*, ROUND(auc, 7) AS auc_over_zero FROM s JOIN a USING (market, confidence_tier)""",
)
def confidence_tier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with projections; one market's players have no history, and keep the sample size of their own."""
    labels = _labels(spark, sf_dir)
    history = props.player_history(labels.filter("market <> 'anytime_td'")).select(*props.KEYS, "player_games_prior", "ord")
    rows = props.attach_tiers(labels.withColumn("sample_size", F.when(F.col("week") > 6, 7)), history, "ord")
    out = props.tier_metrics(rows)
    places = {c: 6 if c in ("avg_sample_size", "mae", "rmse") else 10 if c == "prob_over_zero_mean" else _places(c) for c, kind in out.dtypes if kind == "double"}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


QUALITY_SQL = """q AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS prediction_group, CASE WHEN o_custkey % 10 > 0 THEN o_orderpriority ELSE ' ' END AS market, CASE WHEN o_custkey % 3 = 0 THEN 'dk' WHEN o_custkey % 3 = 1 THEN 'fd ' END AS sportsbook,
  CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 1000 END AS line, CASE WHEN o_orderkey % 7 = 0 THEN 'anytime_td_fallback' END AS line_type, o_totalprice > 200000 AS bettable, CASE WHEN o_custkey % 5 > 0 THEN o_totalprice > 300000 END AS recommended,
  (['strong', 'lean', 'below_threshold', 'no_positive_ev', 'unavailable'])[1 + o_custkey % 5] AS edge_tier, o_custkey % 17 = 0 AS injury_reported, (['ok', 'unknown', 'team_mismatch', 'inactive_roster', 'practice_squad', NULL])[1 + o_custkey % 6] AS roster_flag,
  (o_orderkey % 9)::DOUBLE AS line_range, (o_orderkey % 21 - 10)::DOUBLE AS edge, (o_orderkey % 13 - 6) / 10.0::DOUBLE AS edge_ev, o_custkey % 8 AS book_count FROM orders)"""


@query(
    "prop_quality_report",
    f"""WITH {QUALITY_SQL}, n AS (SELECT * EXCLUDE (prediction_group, market, sportsbook), COALESCE(NULLIF(TRIM(prediction_group), ''), 'unknown') AS prediction_group, COALESCE(NULLIF(TRIM(market), ''), 'unknown') AS market, COALESCE(NULLIF(TRIM(sportsbook), ''), 'no_line') AS sportsbook, COALESCE(roster_flag, 'unknown') AS f FROM q)
    SELECT COALESCE(prediction_group, 'all') AS prediction_group, COALESCE(market, 'all') AS market, COALESCE(sportsbook, 'all') AS sportsbook, COUNT(*) AS rows, COUNT(line) AS rows_with_lines, COUNT(*) FILTER (WHERE line IS NOT NULL AND line_type IS NULL) AS exact_line_rows,
      COUNT(*) FILTER (WHERE line IS NOT NULL AND line_type IS NOT NULL) AS fallback_line_rows, COUNT(*) FILTER (WHERE line IS NULL) AS missing_line_rows, COUNT(*) FILTER (WHERE bettable) AS bettable_rows, COUNT(*) FILTER (WHERE recommended) AS edge_recommended_rows,
      {', '.join(f"COUNT(*) FILTER (WHERE edge_tier = '{t}') AS edge_{t}_rows" for t in ("strong", "lean", "below_threshold", "no_positive_ev", "unavailable"))}, COUNT(*) FILTER (WHERE injury_reported) AS injury_reported_rows, COUNT(*) FILTER (WHERE f <> 'unknown') AS roster_validated_rows,
      COUNT(*) FILTER (WHERE f = 'unknown') AS roster_unknown_rows, COUNT(*) FILTER (WHERE f = 'team_mismatch') AS roster_mismatch_rows, COUNT(*) FILTER (WHERE f IN ('inactive_roster', 'practice_squad')) AS roster_exclusion_rows, ROUND(AVG(CASE WHEN line IS NOT NULL THEN line_range END), 6) AS avg_line_range,
      MAX(CASE WHEN line IS NOT NULL THEN line_range END) AS max_line_range, ROUND(AVG(CASE WHEN line IS NOT NULL THEN ABS(edge) END), 6) AS avg_abs_edge, ROUND(AVG(CASE WHEN line IS NOT NULL THEN edge_ev END), 6) AS avg_edge_ev, ROUND(AVG(CASE WHEN line IS NOT NULL THEN book_count END), 6) AS avg_line_book_count
    FROM n GROUP BY GROUPING SETS ((), (prediction_group), (market), (prediction_group, market, sportsbook))""",
)
def prop_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, key, price = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("prediction_group"), F.when(cust % 10 > 0, F.col("o_orderpriority")).otherwise(" ").alias("market"), F.when(cust % 3 == 0, "dk").when(cust % 3 == 1, "fd ").alias("sportsbook"),
        F.when(key % 4 > 0, price / 1000).alias("line"), F.when(key % 7 == 0, "anytime_td_fallback").alias("line_type"), (price > 200000).alias("bettable"), F.when(cust % 5 > 0, price > 300000).alias("recommended"),
        pick(("strong", "lean", "below_threshold", "no_positive_ev", "unavailable"), cust % 5).alias("edge_tier"), (cust % 17 == 0).alias("injury_reported"), pick(("ok", "unknown", "team_mismatch", "inactive_roster", "practice_squad", None), cust % 6).alias("roster_flag"),
        (key % 9).cast("double").alias("line_range"), (key % 21 - 10).cast("double").alias("edge"), ((key % 13 - 6) / 10.0).alias("edge_ev"), (cust % 8).alias("book_count"),
    )
    out = props.quality_report(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_line_range", "avg_abs_edge", "avg_edge_ev", "avg_line_book_count")})


AUDIT_SQL = """p AS (SELECT o_orderkey AS row, o_orderkey % 60 AS game_id, o_orderpriority AS market, 'n' || o_custkey % 40 AS name_key, (['unknown', 'OK', 'Team_Mismatch', NULL])[1 + o_custkey % 4] AS roster_flag, CASE WHEN o_custkey % 5 = 0 THEN ' FD' END AS sb, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS line FROM orders),
  w AS (SELECT l_orderkey % 60 AS game_id, (['1-URGENT', '2-HIGH', '3-MEDIUM'])[1 + l_partkey % 3] AS market, 'n' || l_suppkey % 40 AS name_key, (['fd', 'dk'])[1 + l_partkey % 2] AS sportsbook, l_tax, l_partkey FROM lineitem WHERE l_quantity > 25 OR l_partkey % 6 <> 2)"""


@query(
    "roster_line_audit",
    f"""WITH {AUDIT_SQL}, raw AS (SELECT market, sportsbook, COUNT(*) AS a FROM w GROUP BY 1, 2), pr AS (SELECT * FROM w WHERE l_tax > 0.06 AND NOT (market = '1-URGENT' AND sportsbook = 'dk')), b AS (SELECT market, sportsbook, COUNT(*) AS b FROM pr GROUP BY 1, 2), m AS (SELECT game_id, market, name_key, sportsbook, COUNT(*) AS m FROM pr GROUP BY ALL),
    e AS (SELECT *, unnest(['dk', 'fd', 'mgm']) AS sportsbook FROM p WHERE COALESCE(LOWER(roster_flag), 'unknown') IN ('unknown', 'team_mismatch')),
    j AS (SELECT e.*, COALESCE(raw.a, 0) AS raw_rows, COALESCE(b.b, 0) AS prepared_line_rows, COALESCE(m.m, 0) AS matchable_line_rows, COALESCE(LOWER(TRIM(sb)) = e.sportsbook AND line IS NOT NULL, FALSE) AS published FROM e LEFT JOIN raw ON raw.market = e.market AND raw.sportsbook = e.sportsbook
      LEFT JOIN b ON b.market = e.market AND b.sportsbook = e.sportsbook LEFT JOIN m ON m.game_id = e.game_id AND m.market = e.market AND m.name_key = e.name_key AND m.sportsbook = e.sportsbook)
    SELECT row, sportsbook, raw_rows, prepared_line_rows, matchable_line_rows, published, CASE WHEN published THEN 'published' WHEN matchable_line_rows > 0 THEN 'matchable_not_published' WHEN raw_rows = 0 THEN 'vendor_no_rows' WHEN prepared_line_rows = 0 THEN 'raw_unprepared' ELSE 'no_matching_line' END AS line_availability_status FROM j""",
)
def roster_line_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predictions, lines as offers of two of three books."""
    cust, key, part = F.col("o_custkey"), F.col("o_orderkey"), F.col("l_partkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    name = lambda n: F.concat(F.lit("n"), (n % 40).cast("string")).alias("name_key")
    predictions = table(spark, sf_dir, "orders").select(
        key.alias("row"), (key % 60).alias("game_id"), F.col("o_orderpriority").alias("market"), name(cust), pick(("unknown", "OK", "Team_Mismatch", None), cust % 4).alias("roster_flag"), F.when(cust % 5 == 0, " FD").alias("sportsbook"),
        F.when(key % 2 == 0, F.col("o_totalprice")).alias("line"),
    )
    raw = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") > 25) | (part % 6 != 2)).select(
        (F.col("l_orderkey") % 60).alias("game_id"), pick(("1-URGENT", "2-HIGH", "3-MEDIUM"), part % 3).alias("market"), name(F.col("l_suppkey")), pick(("FD ", "dk"), part % 2).alias("sportsbook"), "l_tax"
    )
    prepared = raw.filter((F.col("l_tax") > 0.06) & ~((F.col("market") == "1-URGENT") & (F.col("sportsbook") == "dk")))
    out = props.roster_line_audit(predictions, raw, prepared, ["fd", "DK", "mgm"], ["unknown", "team_mismatch"])
    return out.select("row", "sportsbook", "raw_rows", "prepared_line_rows", "matchable_line_rows", "published", "line_availability_status")


@query(
    "labels_to_projections",
    f"""WITH {ROWS_SQL}, x AS (SELECT c.*, ((ASCII(market) % 7) - 1.5::DOUBLE) / 4 AS projection FROM c UNION ALL SELECT season, week, game_id, team, opponent, player_id, market, proj FROM l)
    SELECT season, week, game_id, team, player_id, market, projection, l.v IS NOT NULL AS label_available, projection - l.v AS error, (projection - l.v) * (projection - l.v) AS squared_error, CASE WHEN market IN ('qb_passing_tds', 'anytime_td') THEN ROUND(1 - EXP(-GREATEST(projection, 0)), 8) END AS prob_over_zero
    FROM x LEFT JOIN l USING (season, week, game_id, team, player_id, market)""",
)
def labels_to_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, asked = _labels(spark, sf_dir), _candidates(spark, sf_dir)
    made = asked.select(*props.KEYS, (((F.ascii("market") % 7).cast("double") - 1.5) / 4).alias("projection"))
    rows = made.unionByName(labels.select(*props.KEYS, F.col("model_projection").alias("projection")))
    out = props.labels_to_projections(labels, rows)
    return out.select(*props.KEYS, "projection", "label_available", "error", "squared_error", F.round("prob_over_zero", 8).alias("prob_over_zero"))


@query(
    "prop_probability_input",
    f"""WITH {BETS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, season::INT AS season, week::INT AS week, market, l_quantity - ev1 AS residual, l_quantity > line AS actual_over_line, ev1 - line AS model_edge, ABS(ev1 - line) AS abs_model_edge
    FROM (SELECT g.*, l.l_quantity, CASE WHEN l.l_tax > 0 THEN (l.l_partkey % 50)::DOUBLE END AS line, (l.l_suppkey % 50)::DOUBLE AS ev1 FROM graded g JOIN lineitem l USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)) WHERE line IS NOT NULL AND l_quantity <> line""",
)
def prop_probability_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("season"), F.month("l_shipdate").cast("string").alias("week"), F.concat(F.lit(" "), "l_returnflag").alias("market"),
        F.col("l_quantity").alias("actual_value"), F.when(F.col("l_tax") > 0, F.col("l_partkey") % 50).alias("line"), (F.col("l_suppkey") % 50).alias("model_projection"),
    )
    return props.probability_input(rows).drop("actual_value", "line", "model_projection")


@query(
    "over_probabilities",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS market, YEAR(l_shipdate) * 100 + MONTH(l_shipdate) AS per, (l_partkey % 50)::DOUBLE AS line, (l_suppkey % 50)::DOUBLE AS proj, l_quantity AS v, CASE WHEN l_tax > 0 THEN (l_partkey % 90 + 5) / 100.0 END::DOUBLE AS ip,
      ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_returnflag, YEAR(l_shipdate), MONTH(l_shipdate) ORDER BY l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 DESC) AS i FROM lineitem WHERE l_quantity <> l_partkey % 50),
    c AS (SELECT market, per, v - proj AS r, COUNT(*) AS n FROM p WHERE i = 1 GROUP BY 1, 2, 3), t AS (SELECT DISTINCT market, per, line - proj AS need FROM p),
    h AS (SELECT t.market, t.per, t.need, SUM(CASE WHEN c.r > t.need THEN c.n ELSE 0 END)::DOUBLE AS above, SUM(c.n)::DOUBLE AS n FROM t JOIN c ON c.market = t.market AND c.per < t.per GROUP BY 1, 2, 3),
    o AS (SELECT market, per, SUM((v > line)::INT) AS s, COUNT(*) AS c FROM p GROUP BY 1, 2), b AS (SELECT market, per, SUM(s) OVER w / SUM(c) OVER w::DOUBLE AS base FROM o WINDOW w AS (PARTITION BY market ORDER BY per ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT p.*, v > line AS won, COALESCE(base, 0.5) AS base, COALESCE(h.n, 0) AS n, above / h.n AS raw, CASE WHEN ip IS NOT NULL THEN GREATEST(0.02, LEAST(0.98, ip)) END AS pm FROM p LEFT JOIN b USING (market, per) LEFT JOIN h ON h.market = p.market AND h.per = p.per AND h.need = p.line - p.proj),
    y AS (SELECT *, CASE WHEN n >= 500 THEN GREATEST(0.02, LEAST(0.98, n / (n + 50) * raw + (1 - n / (n + 50)) * base)) END AS pr FROM x),
    k AS (SELECT market, per, COUNT(*) FILTER (WHERE pr IS NOT NULL AND pm IS NOT NULL) AS n, SUM((pr - won::INT) ** 2) FILTER (WHERE pr IS NOT NULL AND pm IS NOT NULL) AS r, SUM((pm - won::INT) ** 2) FILTER (WHERE pr IS NOT NULL AND pm IS NOT NULL) AS m FROM y GROUP BY 1, 2),
    q AS (SELECT market, per, SUM(n) OVER w AS n, SUM(r) OVER w AS r, SUM(m) OVER w AS m FROM k WINDOW w AS (PARTITION BY market ORDER BY per ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT market, per, CASE WHEN n >= 1000 THEN GREATEST(0.15, LEAST(0.95, 0.5 + 6 * (r / n - m / n) / GREATEST(m / n, 1e-6))) END AS w FROM q), f AS (SELECT y.*, z.w, pr IS NOT NULL AND pm IS NOT NULL AND z.w IS NOT NULL AS bl FROM y JOIN z USING (market, per)),
    g AS (SELECT *, CASE WHEN bl THEN GREATEST(0.02, LEAST(0.98, (1 - w) * pr + w * pm)) ELSE COALESCE(pr, pm, GREATEST(0.02, LEAST(0.98, base))) END AS po FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN bl THEN 'market_residual_blend' WHEN pr IS NOT NULL THEN 'residual_cdf' WHEN pm IS NOT NULL THEN 'market_implied_fallback' ELSE 'base_rate_fallback' END AS method, ROUND(pr, 7) AS prob_over_residual, ROUND(po, 7) AS prob_over_model,
      ROUND(CASE WHEN bl THEN w ELSE 0 END, 6) AS market_blend_weight, n::BIGINT AS calibration_sample_size FROM g""",
)
def over_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as several prices on one projection an order."""
    part, supp, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"), F.col("l_returnflag").alias("market"), F.col("l_quantity").alias("actual_value"),
        (part % 50).alias("line"), (supp % 50).alias("model_projection"), F.when(F.col("l_tax") > 0, (part % 90 + 5) / 100.0).alias("implied_probability"), (n * 10000000 + part * 1000 + supp % 1000).alias("seen"),
    )
    out = overs.over_probabilities(props.probability_input(rows), ["l_orderkey", "market", "season", "week"], "seen", 500, 50.0, blend_least=1000)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "method", F.round("prob_over_residual", 7).alias("prob_over_residual"), F.round("prob_over_model", 7).alias("prob_over_model"),
        F.round("market_blend_weight", 6).alias("market_blend_weight"), F.col("calibration_sample_size").cast("bigint").alias("calibration_sample_size"),
    )
