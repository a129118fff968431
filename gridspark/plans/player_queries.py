"""Players, offers and their gaps: customers are the players, orders their games and offers, nations the teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators import players
from gridspark.plans.registry import query, table


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("player_id"), F.concat(F.lit("n"), F.floor("c_acctbal").cast("bigint")).alias("name_key"), F.col("c_nationkey").alias("team"), "c_mktsegment", "c_acctbal"
    )


PEOPLE_SQL = "people AS (SELECT c_custkey AS player_id, 'n' || FLOOR(c_acctbal)::BIGINT AS name_key, c_nationkey AS team, c_mktsegment, c_acctbal FROM customer)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("player_id"), F.year("o_orderdate").cast("bigint").alias("season"), F.month("o_orderdate").cast("bigint").alias("week"),
        F.col("o_orderpriority").alias("market"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"),
    )


ORDERS_SQL = "o AS (SELECT o_orderkey, o_custkey AS player_id, YEAR(o_orderdate) AS season, MONTH(o_orderdate) AS week, o_orderpriority AS market, o_orderstatus AS status, o_totalprice AS value FROM orders)"


@query(
    "active_roster",
    f"""WITH {ORDERS_SQL}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id, market ORDER BY season DESC, week DESC, o_orderkey DESC) AS i FROM o WHERE season <= 1999),
    u AS (SELECT player_id, season, week, arg_max(status, o_orderkey) AS status, arg_max(market, o_orderkey) AS position FROM o GROUP BY 1, 2, 3),
    l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY season DESC, week DESC) AS i FROM u WHERE season <= 1999)
    SELECT player_id, season, week, status, position FROM l WHERE i = 1 AND status IN ('F', 'O') AND position IN ('1-URGENT', '2-HIGH')""",
)
def active_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda c: F.max_by(c, "o_orderkey")
    roster = _orders(spark, sf_dir).groupBy("player_id", "season", "week").agg(last("status").alias("status"), last("market").alias("position"))
    return players.active_roster(roster, 1999, ["F", "O"], ["1-URGENT", "2-HIGH"])


@query(
    "availability_attach",
    f"""WITH {PEOPLE_SQL}, a AS (SELECT CASE WHEN c_mktsegment <> 'MACHINERY' THEN player_id END AS player_id, player_id AS p, name_key, CASE WHEN c_acctbal > 8000 THEN 99 ELSE team END AS current_team,
      CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN TRUE WHEN c_mktsegment = 'HOUSEHOLD' THEN FALSE END AS active, c_mktsegment = 'FURNITURE' AS practice, c_acctbal < -500 AS reserve FROM people WHERE c_mktsegment <> 'AUTOMOBILE'),
    n AS (SELECT name_key, arg_max(a, p) AS x FROM a GROUP BY 1 HAVING COUNT(DISTINCT player_id) = 1),
    j AS (SELECT q.player_id, q.team, CASE WHEN i.current_team IS NOT NULL THEN i ELSE n.x END AS x FROM people q LEFT JOIN a i ON i.player_id = q.player_id LEFT JOIN n ON n.name_key = q.name_key)
    SELECT player_id, x.current_team AS current_team, COALESCE(x.current_team = team AND x.active, FALSE) AS active_current_roster,
      CASE WHEN x.current_team IS NULL THEN 'unknown' WHEN x.current_team <> team THEN 'team_mismatch' WHEN COALESCE(x.active, FALSE) THEN 'ok' WHEN x.reserve THEN 'inactive_roster' WHEN x.practice THEN 'practice_squad'
        WHEN x.active IS NOT NULL THEN 'inactive_roster' ELSE 'unknown' END AS roster_flag FROM j""",
)
def availability_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, segment = _people(spark, sf_dir), F.col("c_mktsegment")
    known = people.filter(segment != "AUTOMOBILE").select(
        F.when(segment != "MACHINERY", F.col("player_id")).alias("player_id"), "name_key", F.when(F.col("c_acctbal") > 8000, 99).otherwise(F.col("team")).alias("current_team"),
        F.when(segment.isin("BUILDING", "MACHINERY"), True).when(segment == "HOUSEHOLD", False).alias("active"), (segment == "FURNITURE").alias("practice"),
        (F.col("c_acctbal") < -500).alias("reserve"), segment.alias("injury_status"), F.col("player_id").alias("priority"),
    )
    return players.attach_availability(people, known).select("player_id", "current_team", "active_current_roster", "roster_flag")


@query(
    "injury_attach",
    f"""WITH {PEOPLE_SQL}, {ORDERS_SQL}, r AS (SELECT o.player_id, CASE WHEN o.player_id % 3 = 0 THEN NULL ELSE o.player_id END AS id, p.name_key, market, value FROM o JOIN people p USING (player_id) WHERE value > 300000),
    a AS (SELECT id, arg_max(market, value) AS m FROM r WHERE id IS NOT NULL GROUP BY 1), b AS (SELECT name_key, arg_max(market, value) AS m FROM r GROUP BY 1)
    SELECT player_id, COALESCE(a.m, b.m) AS market FROM people p LEFT JOIN a ON a.id = p.player_id LEFT JOIN b ON b.name_key = p.name_key""",
)
def injury_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without an id are found by name."""
    people = _people(spark, sf_dir).select("player_id", "name_key")
    reports = _orders(spark, sf_dir).filter("value > 300000").join(people, "player_id").withColumn("player_id", F.when(F.col("player_id") % 3 != 0, F.col("player_id")))
    return players.attach_by_id_then_name(people, reports, "player_id", "name_key", "market", "value").select("player_id", "market")


@query(
    "offer_tiers",
    """WITH p AS (SELECT c_custkey AS row, c_nationkey AS n, c_mktsegment AS s, FLOOR(c_acctbal / 2000)::BIGINT AS c FROM customer), o AS (SELECT s_suppkey AS offer, s_nationkey AS n, CASE WHEN s_acctbal > 4000 THEN 'BUILDING' ELSE 'FURNITURE' END AS s, FLOOR(s_acctbal / 2000)::BIGINT AS c, s_acctbal AS price, s_suppkey % 10 AS line FROM supplier),
    a AS (SELECT row, offer, price, line, 0 AS t FROM p JOIN o USING (n, s, c)), p2 AS (SELECT * FROM p WHERE row NOT IN (SELECT row FROM a)), o2 AS (SELECT * FROM o WHERE offer NOT IN (SELECT offer FROM a)),
    b AS (SELECT row, offer, price, line, 1 AS t FROM p2 JOIN o2 USING (n, c)), e AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row ORDER BY t, price DESC, offer) AS i FROM e), g AS (SELECT row, COUNT(*) AS n_offers, ROUND(AVG(line), 6) AS line_mean, MAX(line) - MIN(line) AS line_range FROM e GROUP BY 1)
    SELECT p.row, x.offer, CASE t WHEN 0 THEN 'strict' WHEN 1 THEN 'loose' END AS tier, price, line, COALESCE(n_offers, 0) AS n_offers, line_mean, line_range FROM p LEFT JOIN x ON x.row = p.row AND i = 1 LEFT JOIN g ON g.row = p.row""",
)
def offer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / 2000).cast("bigint").alias("c")
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s"), cell("c_acctbal"))
    right = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("offer"), F.col("s_nationkey").alias("n"), F.when(F.col("s_acctbal") > 4000, "BUILDING").otherwise("FURNITURE").alias("s"), cell("s_acctbal"),
        F.col("s_acctbal").alias("price_"), (F.col("s_suppkey") % 10).alias("line"),
    )
    out = players.attach_offers(left, right, "row", [("strict", ["n", "s", "c"]), ("loose", ["n", "c"])], F.col("price_"), "offer")
    return out.select("row", "offer", "tier", "price", "line", "n_offers", F.round("line_mean", 6).alias("line_mean"), "line_range")


@query(
    "probability_by_line",
    """WITH p AS (SELECT l_partkey, l_suppkey, ROUND(l_discount, 2) AS line, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS q FROM lineitem GROUP BY ALL)
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.q FROM lineitem l JOIN p ON l.l_partkey = p.l_partkey AND l.l_suppkey = p.l_suppkey AND ROUND(l.l_tax + 0.00001, 2) = p.line""",
)
def probability_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that differ in digits beyond the second meet."""
    lines = table(spark, sf_dir, "lineitem")
    order = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")
    scored = lines.select("l_partkey", "l_suppkey", F.col("l_discount").alias("line"), F.col("l_quantity").alias("q"), order.alias("seen"))
    asked = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_tax") + 0.00001).alias("line"))
    return players.merge_on_line(asked, scored, ["l_partkey", "l_suppkey"], "line", "seen", ["q"], 2).drop("line")


@query(
    "fallback_offers",
    f"""WITH {ORDERS_SQL} SELECT o_orderkey, player_id, market, FALSE AS derived FROM o
    UNION ALL SELECT o_orderkey, player_id, '1-URGENT', TRUE FROM o WHERE market = '2-HIGH' AND player_id NOT IN (SELECT player_id FROM o WHERE market = '1-URGENT')""",
)
def fallback_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return players.fallback_offers(_orders(spark, sf_dir).select("o_orderkey", "player_id", "market"), "1-URGENT", "2-HIGH", ["player_id"])


CANDIDATES_SQL = f"""{PEOPLE_SQL}, {ORDERS_SQL}, f AS (SELECT o.o_orderkey AS offer_id, p.name_key, o.market, [p.team, (p.team + 1) % 25] AS teams FROM o JOIN people p USING (player_id) WHERE season = 2000),
  e AS (SELECT offer_id, name_key, market, unnest(teams) AS team FROM f),
  c AS (SELECT offer_id, p.player_id, team, market FROM e JOIN people p USING (name_key, team) WHERE p.player_id IN (SELECT player_id FROM people WHERE c_mktsegment <> 'FURNITURE')
    AND EXISTS (SELECT 1 FROM o h WHERE h.player_id = p.player_id AND h.market = e.market AND h.season < 2000))"""


def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, orders = _people(spark, sf_dir), _orders(spark, sf_dir)
    offers = orders.filter("season = 2000").join(people, "player_id").select(F.col("o_orderkey").alias("offer_id"), "name_key", "market", F.array("team", (F.col("team") + 1) % 25).alias("teams"))
    active = people.filter("c_mktsegment <> 'FURNITURE'").select("player_id", "team")
    history = orders.filter("season < 2000").select("player_id", "market")
    return players.offered_candidates(offers, F.col("teams"), people.select("player_id", "name_key", "team"), active, history)


@query("offered_candidates", f"WITH {CANDIDATES_SQL} SELECT offer_id, player_id, team, market FROM c")
def offered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offered(spark, sf_dir)


@query(
    "offered_candidates_added",
    f"""WITH {CANDIDATES_SQL}, k AS (SELECT DISTINCT player_id, market FROM o WHERE season = 1999)
    SELECT player_id, market, FALSE AS line_offered FROM k UNION ALL SELECT player_id, market, TRUE FROM (SELECT DISTINCT player_id, market FROM c EXCEPT SELECT player_id, market FROM k)""",
)
def offered_candidates_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _orders(spark, sf_dir).filter("season = 1999").select("player_id", "market").distinct()
    return players.add_missing(known, _offered(spark, sf_dir).select("player_id", "market"), ["player_id", "market"])


@query(
    "game_id_lookup",
    f"""WITH {ORDERS_SQL}, s AS (SELECT season, week, player_id % 32 AS home, o_orderkey % 32 AS away, o_orderkey AS game_id FROM o)
    SELECT season, week, team, opponent, MAX(game_id) AS game_id FROM (SELECT season, week, home AS team, away AS opponent, game_id FROM s UNION ALL SELECT season, week, away, home, game_id FROM s) GROUP BY ALL""",
)
def game_id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = _orders(spark, sf_dir).select("season", "week", (F.col("player_id") % 32).alias("home"), (F.col("o_orderkey") % 32).alias("away"), F.col("o_orderkey").alias("game_id"))
    return players.game_id_lookup(games)


@query(
    "player_actuals",
    """SELECT l_orderkey AS game, l_partkey AS player_id, 'rush' AS role, '{"plays":' || COUNT(*) || ',"big":' || COUNT(*) FILTER (WHERE l_quantity > 25) || '}' AS stats FROM lineitem GROUP BY 1, 2
    UNION ALL SELECT l_orderkey, l_suppkey, 'catch', '{"targets":' || COUNT(*) || '}' FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2""",
)
def player_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game"), F.col("l_partkey").alias("rusher"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("target"), "l_quantity"
    )
    roles = {
        "rush": ("rusher", [F.count(F.lit(1)).alias("plays"), F.count_if(F.col("l_quantity") > 25).alias("big")]),
        "catch": ("target", [F.count(F.lit(1)).alias("targets")]),
    }
    return players.actuals(plays, roles, ["game"])


@query(
    "defensive_credits",
    """SELECT l_orderkey, player_id, SUM(share) AS credit FROM (SELECT l_orderkey, unnest([l_partkey, CASE WHEN l_linenumber > 1 THEN l_suppkey END]) AS player_id, unnest([1.0, 0.5])::DOUBLE AS share FROM lineitem) WHERE player_id IS NOT NULL GROUP BY 1, 2""",
)
def defensive_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("sack"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("half"))
    return players.credits(plays, {"sack": 1.0, "half": 0.5}, ["l_orderkey"])


@query(
    "player_projections",
    f"""WITH {ORDERS_SQL}, g AS (SELECT player_id, COUNT(DISTINCT (season, week)) AS games, arg_max(market, season * 100 + week) AS team, MAX(season) AS last_season, SUM(CAST(ROUND(value) AS BIGINT)) AS v
      FROM (SELECT player_id, season, week, MAX(market) AS market, SUM(ROUND(value)) AS value FROM o GROUP BY 1, 2, 3) GROUP BY 1)
    SELECT player_id, games, team, last_season, v::BIGINT AS v, ROUND(v / games::DOUBLE, 6) AS v_pg, ROW_NUMBER() OVER (PARTITION BY team ORDER BY v / games::DOUBLE DESC, player_id) AS team_rank FROM g""",
)
def player_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = _orders(spark, sf_dir).groupBy("player_id", "season", "week").agg(F.max("market").alias("team"), F.sum(F.round("value").cast("bigint")).alias("v"))
    out = players.projections(games, ["player_id"], ["season", "week"], ["v"], "team", "v")
    return out.withColumn("v_pg", F.round("v_pg", 6)).withColumn("team_rank", F.col("team_rank").cast("bigint"))


@query(
    "player_penalties",
    """SELECT l_suppkey AS player_id, COUNT(*) AS penalties, SUM(l_quantity::BIGINT)::BIGINT AS yards, COUNT(DISTINCT l_orderkey) AS games, arg_max(l_shipdate::VARCHAR, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS name,
      ROUND(COUNT(*) / COUNT(DISTINCT l_orderkey)::DOUBLE, 6) AS penalties_pg, ROUND(SUM(l_quantity::BIGINT)::DOUBLE / COUNT(DISTINCT l_orderkey), 6) AS yards_pg FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""",
)
def player_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("player_id"), F.col("l_orderkey").alias("game_id"), F.col("l_quantity").cast("bigint").alias("yards"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("name"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("at"),
    )
    return players.penalties(plays, ["player_id"], "name", "at").withColumns({c: F.round(c, 6) for c in ("penalties_pg", "yards_pg")})


@query(
    "prior_player_summary",
    f"""WITH {ORDERS_SQL}, e AS (SELECT player_id, market, season, week, SUM(CAST(ROUND(value * 100) AS BIGINT))::BIGINT AS v, MAX(status) AS s FROM o GROUP BY 1, 2, 3, 4)
    SELECT player_id, market, COUNT(v) AS n, ROUND(AVG(v), 4) AS mean, arg_max(s, season * 100 + week) AS status FROM e WHERE (season, week) < (1999, 6) GROUP BY 1, 2""",
)
def prior_player_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _orders(spark, sf_dir).groupBy("player_id", "market", "season", "week").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"), F.max("status").alias("status"))
    return players.prior_summary(labels, ["player_id", "market"], ["season", "week"], (1999, 6), "v", "status").withColumn("mean", F.round("mean", 4))


@query(
    "novelty_labels",
    """WITH c AS (SELECT c_custkey AS player_id, unnest(['1-URGENT', '2-HIGH', '5-LOW', 'none']) AS market FROM customer)
    SELECT player_id, market, EXISTS (SELECT 1 FROM orders WHERE o_custkey = player_id AND o_orderpriority = market) AS label FROM c""",
)
def novelty_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _orders(spark, sf_dir).select("player_id", "market")
    return players.novelty_labels(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id")), events, ["player_id"], ["1-URGENT", "2-HIGH", "5-LOW", "none"])


@query(
    "offer_gaps",
    """WITH x AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, EXISTS (SELECT 1 FROM orders h WHERE h.o_custkey = o.o_custkey AND h.o_orderdate < TIMESTAMP '1996-01-01') AS past FROM orders o)
    SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'non_player' WHEN o_orderpriority = '5-LOW' THEN 'no_availability' WHEN o_orderstatus = 'P' THEN 'injured_reserve' WHEN o_orderpriority LIKE '4%' THEN 'practice_squad'
      WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'inactive' WHEN o_orderpriority LIKE '3%' THEN 'position' WHEN NOT past THEN 'no_history' ELSE 'unexplained' END AS reason FROM x""",
)
def offer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    early = orders.filter("o_orderdate < TIMESTAMP_NTZ '1996-01-01'").select("o_custkey").distinct().withColumn("past", F.lit(True))
    rows = orders.join(early, "o_custkey", "left")
    price, mark, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    reason = players.offer_gap(
        price >= 20000, mark != "5-LOW", status == "P", F.startswith(mark, F.lit("4")), ~((status == "O") & (price > 200000)), ~F.startswith(mark, F.lit("3")), F.col("past").isNotNull()
    )
    return rows.select("o_orderkey", reason.alias("reason"))


@query(
    "line_coverage",
    f"""WITH {ORDERS_SQL}, f AS (SELECT *, value > 50000 AS prepared, value > 100000 AND status <> 'P' AS matched, value > 100000 AND status = 'F' AND market <> '5-LOW' AS published FROM o),
    g AS (SELECT market, status, 0 AS a, COUNT(*) AS raw, COUNT(DISTINCT player_id) AS players, COUNT(*) FILTER (WHERE prepared) AS prepared, COUNT(*) FILTER (WHERE matched) AS matched, COUNT(*) FILTER (WHERE published) AS published FROM f GROUP BY 1, 2
      UNION ALL SELECT 'all', 'all', 1, COUNT(*), COUNT(DISTINCT player_id), COUNT(*) FILTER (WHERE prepared), COUNT(*) FILTER (WHERE matched), COUNT(*) FILTER (WHERE published) FROM f)
    SELECT market, status AS book, raw, players, prepared, matched, published, CASE WHEN published > 0 THEN 'published' WHEN matched > 0 THEN 'matched_not_published' WHEN prepared > 0 THEN 'prepared_not_matched' ELSE 'not_prepared' END AS status FROM g""",
)
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, status, market = F.col("value"), F.col("book"), F.col("market")
    rows = _orders(spark, sf_dir).withColumnRenamed("status", "book").withColumns(
        {"prepared": value > 50000, "matched": (value > 100000) & (status != "P"), "published": (value > 100000) & (status == "F") & (market != "5-LOW")}
    )
    return players.line_coverage(rows, ["market", "book"])


@query(
    "model_matrix",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, LEAST(GREATEST(l_quantity, 5), 40)::DOUBLE AS l_quantity, CASE WHEN l_linenumber > 3 THEN l_tax ELSE 0 END AS tax, 0.0::DOUBLE AS not_there FROM lineitem""",
)
def model_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that hold nothing are dropped first, and one that the model wants is made up."""
    lines = table(spark, sf_dir, "lineitem").withColumn("tax", F.when(F.col("l_linenumber") > 3, F.col("l_tax"))).withColumn("zero", F.lit(0)).withColumn("none", F.lit(None).cast("string"))
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    full = players.drop_empty_columns(lines, keep)
    assert not {"zero", "none"} & set(full.columns)
    return players.matrix(full, ["l_quantity", "tax", "not_there"], {"l_quantity": (5, 40)}, keep)
