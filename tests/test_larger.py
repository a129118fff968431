"""What shows only on larger tables, made small."""

import random
from decimal import Decimal
from functools import reduce

import duckdb
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import aggregates, football, grading, joins, lines, manifest, players, props, walkforward, weather
from gridspark.plans.catalog import ORACLES, QUERIES
from tests.oracle import connect, differences


def test_draws_are_hashed_once(spark):
    df = spark.range(50).select("id", (F.col("id") % 7 / 7.0).alias("a"), (F.col("id") % 5 / 5.0).alias("b"))
    out = grading.bootstrap_gap(df, ["id"], F.col("a"), F.col("b"), 40, 42)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_ratings_of_many_games_a_week_equal_their_sql(spark, tmp_path):
    """With dozens of games a side and week the ratings swing: the last digit of a sum shows after some weeks."""
    con, rng = duckdb.connect(), random.Random(3)
    con.execute("CREATE TABLE customer AS SELECT i::BIGINT AS c_custkey, i::INT AS c_nationkey FROM range(25) r(i)")
    con.execute("CREATE TABLE supplier AS SELECT i::BIGINT AS s_suppkey, i::INT AS s_nationkey FROM range(25) r(i)")
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP)")
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_tax DOUBLE)")
    orders = [(16 * n, rng.randrange(25), n // 200) for n in range(200 * 60)]
    con.execute("INSERT INTO orders SELECT k, c, TIMESTAMP '1995-01-02' + INTERVAL 7 DAY * w FROM (SELECT unnest(?) AS k, unnest(?) AS c, unnest(?) AS w)", [list(x) for x in zip(*orders)])
    lines = [(k, rng.randrange(25), float(rng.randint(1, 50)), rng.randint(0, 8) / 100) for k, _, _ in orders for _ in range(4)]
    con.execute("INSERT INTO lineitem SELECT unnest(?), unnest(?), unnest(?), unnest(?)", [list(x) for x in zip(*lines)])
    for name in ("customer", "supplier", "orders", "lineitem"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    assert differences(QUERIES["elo_ratings"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["elo_ratings"]) is None


def test_places_equally_far_go_by_their_key(spark):
    """The same distance to both sides, which differs in its last digit."""
    left = spark.createDataFrame([(0, 50.0, 33.3)], "a int, lat double, lon double")
    for signs in ((1, -1), (-1, 1)):
        right = spark.createDataFrame([(i, 50.0, 33.3 + s * 2.3) for i, s in enumerate(signs, 1)], "b int, lat double, lon double")
        assert [(r.b, r["rank"]) for r in joins.nearest_places(left, right, "a", "b", 1, 900.0).collect()] == [(1, 1)]


def most(df, kind: str, metric: str) -> int:
    """The largest ``metric`` of the executed plan's nodes whose class names hold ``kind``."""

    def of(node) -> int:
        metrics, name = node.metrics(), node.getClass().getSimpleName()
        own = int(metrics.apply(metric).value()) if kind in name and metrics.contains(metric) else 0
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        children = node.children()
        return max([own, *map(of, [*inner, *[children.apply(i) for i in range(children.size())]])])

    df.collect()
    return of(df._jdf.queryExecution().executedPlan())


def join_rows(df) -> int:
    return most(df, "Join", "numOutputRows")


def test_offers_of_one_key_are_summed_before_they_meet(spark):
    left = spark.createDataFrame([(i, 1) for i in range(300)] + [(300, 2), (301, None)], "row int, n int")
    right = spark.createDataFrame([(i, 1, float(i % 7), i % 10) for i in range(300)] + [(300, None, 1.0, 1)], "offer int, n int, p double, line int")
    out = players.attach_offers(left, right, "row", [("strict", ["n"])], F.col("p"), "offer")
    assert join_rows(out) <= 1000
    got = {r.row: (r.offer, r.tier, r.price, r.n_offers, r.line_mean, r.line_range) for r in out.collect()}
    assert got[0] == got[299] == (6, "strict", 6.0, 300, 4.5, 9) and got[300] == got[301] == (None, None, None, 0, None, None)


def test_events_of_one_time_are_matched_once(spark):
    games = spark.createDataFrame([(i, 2020, 1, "A", "B", f"2020-01-0{1 + i % 2} 00:00:00" if i else None, None, "pending") for i in range(300)], "game_id int, season int, week int, home string, away string, kickoff string, event_id string, events_status string")
    events = spark.createDataFrame([(2020, 1, "A", "B", f"e{i:03}", f"2020-01-0{2 + i % 2} 00:00:00" if i else None) for i in range(300)], "season int, week int, home string, away string, event_id string, starts string")
    out = manifest.match_events(games.withColumn("kickoff", F.to_timestamp("kickoff")), events.withColumn("starts", F.to_timestamp("starts")))
    assert join_rows(out) <= 1000
    got = {r.game_id: r.event_id for r in out.collect()}
    assert len(got) == 300 and (got[0], got[1], got[2]) == ("e000", "e002", "e002")


def test_a_task_adds_up_its_rows_by_score(spark):
    df = spark.range(0, 40_000, 1, 1).select("id", ((F.col("id") % 4) / 4 + 0.1).alias("a"), ((F.col("id") % 3) / 4 + 0.1).alias("b"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    assert 0 < most(aggregates.bootstrap_auc(df, ["id"], "a", "b", "y", 2), "ShuffleExchange", "shuffleRecordsWritten") <= 60


def test_sums_of_teams_are_not_shuffled_by_game(spark):
    out = QUERIES["season_team_table"](spark, "/root/testdata/sf0.01")
    assert 0 < most(out, "ShuffleExchange", "dataSize") < 120_000 * 100


def test_keys_are_cleaned_once_where_they_are_repeated(spark):
    rows = [(2020, 1, "2020_1_KC_WSH", " wsh" if i % 2 else "WAS", "KC", "p", "RB_yards", float(i), i) for i in range(300)] + [(2020, 1, "2020_1_KC_WSH", "WAS", "KC", "p", "rb_yards", None, 999)]
    labels = spark.createDataFrame(rows, "season int, week int, game_id string, team string, opponent string, player_id string, market string, actual_value double, ord long")
    out = props.prepare_labels(labels, ["rb_yards"], "ord")
    assert 0 < most(out, "Generate", "numOutputRows") <= 10
    assert [(r.team, r.market, r.actual_value, r.ord) for r in out.collect()] == [("WAS", "rb_yards", 299.0, 299)]


def test_labels_are_made_once_for_history_and_both_contexts(spark):
    labels = spark.createDataFrame([(2020, w, f"2020_{w}_KC_WAS", "WAS", "KC", "p", "rb_yards", float(w), w) for w in range(1, 6)], "season int, week int, game_id string, team string, opponent string, player_id string, market string, actual_value double, ord long")
    made = props.prepare_labels(labels, ["rb_yards"], "ord")
    for out in (props.features(made), props.features(made, props.prepare_candidates(labels.drop("actual_value"), ["rb_yards"], "ord"))):
        assert "max_by(" not in out._jdf.queryExecution().optimizedPlan().toString().lower() and out.count() == 5


def test_tiers_are_made_once_for_all_sets(spark):
    rows = spark.range(40).select(F.md5(F.col("id").cast("string")).alias("market"), F.lit("low").alias("confidence_tier"), F.lit(3).alias("sample_size"), F.lit(1.0).alias("model_projection"), F.lit(2.0).alias("actual_value"), (F.col("id") % 2 == 0).alias("actual_over_zero"), F.lit(0.5).alias("prob_over_zero"))
    out = props.tier_metrics(rows)
    assert "md5(" not in out._jdf.queryExecution().optimizedPlan().toString().lower() and out.count() == 82


def offers(spark):
    rows = [(2020, 1, "2020_1_KC_WAS", "rush_yards", "dk", "Al Stone", float(i), True, -110.0, -110.0) for i in range(300)]
    offered = spark.createDataFrame(rows, "season int, week int, game_id string, market string, sportsbook string, player_name string, line double, comparable boolean, over_odds double, under_odds double")
    seen = [(2020, 1, "2020_1_KC_WAS", "rush_yards", f"P{i}", "Al Stone", 10.0 + i, 20.0, n) for i in range(3) for n in range(50)]
    made = spark.createDataFrame(seen, "season int, week int, game_id string, market string, player_id string, player_name string, projection double, actual double, seen long")
    known = spark.createDataFrame([], "season int, week int, team string, name_key string, prefix_key string, player_id string, alias string, confidence double")
    return lines.match_lines(lines.prepare_lines(offered), lines.prepare_predictions(made, "seen"), known)


def test_lines_of_one_name_are_matched_once(spark):
    out = offers(spark)
    assert join_rows(out) <= 300
    assert {(r.match_method, r.player_id, r.projection) for r in out.collect()} == {("strict_prefix", "P0", 10.0)} and out.count() == 300


def test_sums_of_offers_are_made_before_sets(spark):
    out = lines.join_summary(offers(spark))
    assert 0 < most(out, "Expand", "numOutputRows") <= 100
    got = {(r.market, r.sportsbook): (r.lines, r.matched, r.games, r.players, r.picks, round(r.mean_edge, 6), r.strict_prefix) for r in out.collect()}
    assert got["all", "all"] == got["rush_yards", "all"] == got["all", "dk"] == (300, 300, 1, 1, 298, -139.5, 300)


def test_equal_residuals_are_counted_before_the_tree(spark):
    df = spark.range(600).select(F.lit("k").alias("k"), (F.col("id") % 4).alias("w"), (F.col("id") % 3).cast("double").alias("r"), F.lit(0.5).alias("x"))
    out = walkforward.residual_cdf(df, ["k"], "w", "r", "x", "o", shrink=1.0, base=0.0)
    assert most(out, "Generate", "numOutputRows") <= 20 and most(out, "SortMergeJoin", "numOutputRows") == 0
    assert {(r.w, r.o, r.o_n) for r in out.collect()} == {(w, 100 * w / (150 * w + 1), 150 * w) for w in range(4)} and out.count() == 600


def test_weather_of_a_window_is_free_of_the_order_of_rows(spark):
    """A mean of eight winds that ends in a tie at the sixth digit, and two temperatures of one second; both ways round."""
    rng = random.Random(1)
    winds = next(w for w in ([rng.randrange(1, 40_000) / 2000 for _ in range(8)] for _ in range(1000)) if reduce(float.__add__, w) != reduce(float.__add__, w[::-1]))
    games, found = spark.createDataFrame([(1, 5, 9000)], "game_id int, place int, kickoff int"), []
    hours = [(5, 9000, t, w, None, None, "s") for t, w in zip([None, 40.2, 40.1, 50.0, 50.0, 50.0, 50.0, 50.0], winds, strict=True)]
    for rows in (hours, hours[::-1]):
        df = spark.createDataFrame(rows, "place int, at int, temp double, wind double, precip double, source string, stations string").coalesce(1)
        found.append(weather.window_aggregate(games, df, "place", "kickoff", "at", 60).select("wind_mean", "temp_kickoff", "temp_mean").first())
    assert found[0] == found[1] == (float(sum(Decimal(str(w)) for w in winds) / 8), 40.1, float(Decimal("330.3") / 7))


def test_weather_of_dense_places_equals_its_sql(spark, tmp_path):
    """Means of eight winds that end in ties at the sixth digit, and two temperatures of one second; the SQL on one thread, whose sums go in the order of the table."""
    con, rng = duckdb.connect(), random.Random(4)
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    kinds = ["purchase", "view", "view", "click", "error", "signup", "view", "click", "click"]
    events = [(i, 60 * max(i % 9, 2), i // 9, kinds[i % 9], rng.randrange(1, 40_000) / 100) for i in range(9 * 600)]
    con.execute("INSERT INTO events SELECT k, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * t, u, e, v FROM (SELECT unnest(?) AS k, unnest(?) AS t, unnest(?) AS u, unnest(?) AS e, unnest(?) AS v)", [list(x) for x in zip(*events)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    one = connect(str(tmp_path))
    one.execute("SET threads = 1")
    assert differences(QUERIES["weather_window"](spark, str(tmp_path)), one, ORACLES["weather_window"]) is None
    back = spark.read.parquet(f"{tmp_path}/events.parquet").orderBy(F.desc("event_id"))
    back.coalesce(1).write.parquet(f"{tmp_path}/back/events.parquet")
    assert differences(QUERIES["weather_window"](spark, f"{tmp_path}/back"), one, ORACLES["weather_window"]) is None


def test_weather_mean_of_what_is_no_decimal(spark):
    for values in ([1.0, float("nan")], [1e30, 3e30], [1.5, None, float("inf")]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        a, b = df.select(weather.exact_mean(F.col("v")), F.avg("v")).first()
        assert str(a) == str(b)
    assert spark.createDataFrame([(None,)], "v double").select(weather.exact_mean(F.col("v"))).first()[0] is None


def test_drives_are_dealt_once_in_tasks_of_so_many_plays(spark, monkeypatch):
    """No sums before the shuffle, where a drive's few plays would make as many groups as rows, and one shuffle for drives, their order and games."""
    monkeypatch.setattr(football, "TASK_PLAYS", 50)
    flags = {c: (F.col("id") % n == 0).cast("int") for c, n in (("drive_ended_with_score", 5), ("drive_inside20", 3), ("touchdown", 7))}
    pbp = spark.range(2000).select(
        F.lit(2020).alias("season"), (F.col("id") % 17).alias("week"), (F.col("id") % 170).alias("game_id"), (F.col("id") % 2).alias("posteam"), (1 - F.col("id") % 2).alias("defteam"),
        F.floor(F.col("id") / 500).alias("drive"), (F.col("id") % 9 - 4.0).alias("epa"), (F.col("id") % 40).alias("yardline_100"), *[c.alias(n) for n, c in flags.items()],
    )
    out = football.drive_epa(pbp)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "HashAggregate" not in plan.split("Exchange")[1]
    assert f", {2000 // 50}), REPARTITION_BY_NUM" in plan
    assert "REPARTITION_BY_NUM" in football.red_zone(pbp)._jdf.queryExecution().executedPlan().toString()
    got = {r.game_id: r for r in out.collect()}
    assert len(got) == 170 and sum(r.drives * r.plays_per_drive for r in got.values()) == 2000 and got[0].opening_epa == sum(i % 9 - 4.0 for i in range(0, 500, 170))


def test_places_are_looked_for_where_they_are_dense(spark):
    """Rows and places of one position, dense and lone ones, a pole, equal keys, and what has no coordinates; against all pairs."""
    rng = random.Random(5)
    near = lambda n: [(50 + rng.random() * 4, 5 + rng.random() * 4) for _ in range(n)]
    odd = [(-90.0, 10.0), (-89.5, -170.0), (0.0, 180.0), (-0.0, -179.9), (45.0, 5.0), (None, 1.0), (float("nan"), 1.0)]
    left = spark.createDataFrame([(i % 390, *p) for i, p in enumerate([*near(300), *[(51.0, 6.0)] * 100, *odd])], "a int, lat double, lon double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate([*near(600), *[(51.0, 6.0)] * 50, *odd])], "b int, lat double, lon double")
    out = joins.nearest_places(left, right, "a", "b", 3, 900.0)
    assert join_rows(out) <= 100_000
    all_pairs = left.select("a", F.col("lat").alias("x"), F.col("lon").alias("y")).crossJoin(right).withColumn("km", geo.haversine_km(F.col("x"), F.col("y"), F.col("lat"), F.col("lon"))).filter("km <= 900")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.round("km", 7), "b"))
    want = all_pairs.withColumn("rank", rank).filter("rank <= 3").select("a", "b", "km", "rank")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1000
