"""Small hand-checked frames: nulls, ties, empty tables, edges."""

import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import bins, geo, odds, text
from gridspark.operators import aggregates, clean, joins, quality, reshape, sequential, walkforward, windows
from gridspark.sources import io


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_odds_at_zero_and_null(spark):
    df = spark.createDataFrame([(0.0,), (None,), (-271.0,), (220.0,)], "o double")
    assert values(df, odds.american_to_implied(F.col("o"))) == [0.5, None, pytest.approx(271 / 371), pytest.approx(100 / 320)]
    assert values(df, odds.american_to_implied(F.col("o"), None))[0] is None
    assert values(df, odds.american_to_decimal(F.col("o")))[:2] == [None, None]
    home, away = 271 / 371, 100 / 320
    assert values(df.limit(1), odds.no_vig(F.lit(home), F.lit(away)) + odds.no_vig(F.lit(away), F.lit(home))) == [pytest.approx(1)]


def test_normal_cdf_is_close(spark):
    df = spark.createDataFrame([(z / 10,) for z in range(-40, 41)], "z double")
    for z, p in df.select("z", odds.normal_cdf(F.col("z"))).collect():
        assert p == pytest.approx((1 + math.erf(z / math.sqrt(2))) / 2, abs=2e-7)


def test_names_and_numbers(spark):
    names = spark.createDataFrame([("Smith Jr., John",), ("T.J. O'Neil III",), ("Cher",), (None,), ("",)], "n string")
    assert values(names, text.initial_last_key(F.col("n")))[2:] == [None, None, None]
    assert values(names, text.full_key(F.col("n")))[0] in ("john:smith", "jr:smith")
    raw = spark.createDataFrame([("12:30",), ("57.8%",), ("#3",), ("T-7",), ("1,234",), ("--",), ("−5",), ("x",), (None,)], "x string")
    assert values(raw, text.clean_number(F.col("x"))) == [750.0, 57.8, 3.0, 7.0, 1234.0, None, -5.0, None, None]
    ids = spark.createDataFrame([("12.0",), ("ab ",), (None,)], "x string")
    assert values(ids, text.text_id(F.col("x"))) == ["12", "ab", None]
    flags = spark.createDataFrame([("Yes",), ("0",), ("?",), (None,)], "x string")
    assert values(flags, text.to_flag(F.col("x"), True)) == [True, False, True, True]


def test_bins_on_their_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,), (None,)], "x double")
    assert values(df, bins.left_closed(F.col("x"), [0, 0.5, 1])) == [0, 1, 1, None, None]
    assert values(df, bins.right_closed(F.col("x"), [0, 0.5, 1])) == [None, 0, 1, None, None]
    assert values(df, bins.right_closed(F.col("x"), [0, 0.5, 1], True))[0] == 0


def test_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    assert values(df, geo.haversine_km(*map(F.col, "abcd"))) == [pytest.approx(math.pi * 6371)]


def test_forms(spark):
    df = spark.createDataFrame([("a", 1, 200.0), ("a", 2, 260.0), ("a", 3, 320.0), ("b", 1, None)], "k string, t int, v double")
    w = windows.ordered(["k"], ["t"])
    out = df.select("k", "t", windows.prior_mean(F.col("v"), w).alias("m"), windows.prior_std(F.col("v"), w).alias("s")).orderBy("k", "t").collect()
    assert [r.m for r in out] == [None, 200.0, 230.0, None]
    assert [r.s for r in out][:3] == [None, None, pytest.approx(42.4264, abs=1e-4)]
    ewm = windows.ewm_prior(df, "v", ["k"], ["t"], 3, "e").orderBy("k", "t").collect()
    assert [r.e for r in ewm] == [None, 200.0, 230.0, None]
    runs = windows.run_length(df, F.col("v") > 210, ["k"], ["t"], "n").orderBy("k", "t").collect()
    assert [r.n for r in runs] == [0, 1, 2, 0]


def test_asof_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 9), (4, None, 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 3, 30), ("a", 4, 40), ("b", 10, 1)], "k string, s int, v int")
    at = {r.id: (r.s_asof, r.v) for r in joins.asof_join(left, right, "k", "t", "s", ["v"]).collect()}
    assert at == {1: (4, 40), 2: (3, 30), 3: (None, None), 4: (None, None)}
    before = {r.id: r.v for r in joins.asof_join(left, right, "k", "t", "s", ["v"], strict=True).collect()}
    assert before == {1: 40, 2: None, 3: None, 4: None}


def test_interval_ends_are_included(spark):
    left = spark.createDataFrame([(1, "a", "2024-01-08 00:00:00")], "id int, k string, t string").withColumn("t", F.to_timestamp("t"))
    right = spark.createDataFrame([(i, "a", s) for i, s in enumerate(["2024-01-01 00:00:00", "2023-12-31 23:59:59", "2024-01-08 00:00:00", "2024-01-08 00:00:01"])], "n int, k string, s string")
    out = joins.interval_join(left, right.withColumn("s", F.to_timestamp("s")), ["k"], "t", "s", "days", 7)
    assert sorted((r.n, r.days) for r in out.collect()) == [(0, 7.0), (2, 0.0)]


def test_tiers_need_one_value(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "row int, p string, q string")
    right = spark.createDataFrame([("a", "x", "one"), ("a", "y", "two"), ("a", "y", "three"), ("b", "w", "four")], "p string, q string, v string")
    out = {r.row: (r.v, r.match_method) for r in joins.tiered_match(left, right, "row", [("strict", ["p", "q"]), ("loose", ["p"])], "v").collect()}
    assert out == {1: ("one", "strict"), 2: (None, None), 3: ("four", "loose")}


def test_sweep_keeps_empty_thresholds(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.3, -1.0), (0.3, None)], "m double, p double")
    out = {r.threshold: (r.bets, r.roi) for r in aggregates.threshold_sweep(df, "m", [0.0, 0.2, 0.3], aggregates.bet_record(F.col("p"))).collect()}
    assert out == {0.0: (2, 0.0), 0.2: (1, -1.0), 0.3: (None, None)}
    assert aggregates.threshold_sweep(df.limit(0), "m", [0.0], aggregates.bet_record(F.col("p"))).count() == 1


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "p double, y int")
    assert aggregates.auc(df, "p", "y").first().auc == 0.875
    assert aggregates.auc(df.filter("y = 1"), "p", "y").first().auc is None


def test_residual_history_is_strictly_earlier(spark):
    rows = [("m", w, float(r), 10.0) for w, r in [(1, 5), (1, 15), (2, 20), (2, 0), (3, 11)]] + [("n", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, w int, r double, x double")
    out = {(r.k, r.w, r.r): (r.o, r.o_n) for r in walkforward.residual_cdf(df, ["k"], "w", "r", "x", "o", shrink=2.0).collect()}
    assert out[("m", 1, 5.0)] == (0.5, 0) and out[("n", 1, 1.0)] == (0.5, 0)
    assert out[("m", 2, 20.0)] == (0.5, 2) and out[("m", 3, 11.0)] == (0.5, 4)


def test_platt_recovers_a_slope(spark):
    df = spark.range(4000).select((F.col("id") % 41 / 10 - 2).alias("s"), F.expr("(id * 7919) % 1000 / 1000.0").alias("u"))
    df = df.withColumn("y", (F.col("u") < odds.sigmoid(0.5 + 2 * F.col("s"))).cast("int"))
    a, b = walkforward.platt(df, "s", "y")
    assert a == pytest.approx(0.5, abs=0.2) and b == pytest.approx(2, abs=0.3)
    assert walkforward.platt(df.limit(0), "s", "y") == (0.0, 0.0)


def test_elo_reads_the_week_before(spark):
    rows = [(1, 2020, 1, "a", "x", "y", 10.0, 3.0), (1, 2020, 1, "b", "x", "z", 1.0, 7.0), (1, 2020, 2, "c", "y", "x", None, None), (1, 2021, 1, "d", "x", "y", 3.0, 3.0)]
    games = spark.createDataFrame(rows, "league int, season int, week int, game_id string, home string, away string, home_score double, away_score double")
    out = {r.game_id: r for r in sequential.elo(games, "league").collect()}
    assert out["a"].home_elo == out["b"].home_elo == 1500
    moved = out["c"].away_elo
    assert moved != 1500 and out["d"].home_elo == pytest.approx(moved + 0.33 * (1500 - moved))


def test_incremental_tables(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(1, 9), (None, 8), (2, 7)], "k int, w int")
    assert sorted((r.k or 0, r.v, r.w) for r in clean.append_new(old, new, ["k"]).collect()) == [(0, "b", None), (1, "a", None), (2, None, 7)]
    assert clean.content_hash(old).first() == clean.content_hash(old.select("v", "k").orderBy("v")).first()
    diff = clean.snapshot_diff(old, old.withColumn("v", F.lit(None).cast("string")), ["k"], ["v"]).filter("k = 1").collect()
    assert [(r.before, r.after) for r in diff] == [("a", None)]


def test_conform_and_quality(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("1", float("nan")), ("x", 2.0)], "a string, b double")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("c", T.StringType())])
    assert [tuple(r) for r in io.conform(df, schema).collect()] == [(1, None), (None, None)]
    clear = io.nan_to_null(df)
    assert quality.completeness(clear, ["b"]).first().fill_rate == 0.5
    assert quality.validate(clear, {"b": F.col("b") > 0}).first().failures == 1
    assert quality.select_features(clear, ["b"], least=1) == []


def test_reshape(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "q")], "id int, x_home double, x_away double, y_home string")
    assert reshape.auto_diffs(df).first().x_diff == -1.0
    out = reshape.explode_segments(df, {"a": F.col("x_home") > 1, "b": F.col("x_away") > 9, "c": F.lit(True)})
    assert sorted(values(out, "segment")) == ["a", "c"]


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "s int, v string"), path, ["s"])
    io.write_partitions(spark.createDataFrame([(2, "c")], "s int, v string"), path, ["s"])
    assert sorted((r.s, r.v) for r in io.read_table(spark, path).collect()) == [(1, "a"), (2, "c")]


def test_bootstrap_gap_is_the_mean_difference_with_its_deviation(spark):
    from gridspark.operators import grading

    rows = [(i, float(i % 7), float(i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    run = lambda seed: grading.bootstrap_gap(df, ["id"], F.col("a"), F.col("b"), 200, seed).first()
    out, gaps = run(1), [a - b for _, a, b in rows]
    mean = sum(gaps) / len(gaps)
    error = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / len(gaps) ** 0.5
    assert abs(out.gap - mean) < 1e-12 and abs(out.sd / error - 1) < 0.2 and abs(out.z - out.gap / out.sd) < 1e-9
    assert run(1) == out and run(2).sd != out.sd


def test_actuals_that_come_twice_are_an_error(spark):
    from gridspark.operators import grading

    p = spark.createDataFrame([(1, 0.6, 1.0, -110.0, 100.0)], "game_id long, home_win_prob double, pred_home_margin double, home_moneyline double, away_moneyline double")
    r = spark.createDataFrame([(1, 3.0, True)] * 2, "game_id long, home_margin double, actual_home_win boolean")
    with pytest.raises(Exception, match="comes twice"):
        grading.versus_actual(p, r, ["game_id"]).collect()


def test_html_rows_leave_headers_and_tags(spark):
    from gridspark.sources import feeds

    html = "<table><tr><th>a</th><th>b</th></tr>\n<tr><td> <b>x</b> </td><td>1,234%</td></tr><tr><td>one cell</td></tr></table>"
    out = feeds.html_rows(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "html", ["a", "b"])
    assert [tuple(r) for r in out.withColumn("b", feeds.number(F.col("b"))).collect()] == [(1, "x", 1234.0), (1, "one cell", None)]


def test_nearest_and_asof_across_slices(spark):
    """Small slices of time carry over; ties go to the smaller id; no match ahead or behind."""
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 5), (3, "b", 7), (4, "a", 50)], "id int, k string, s long").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame([(9, "a", 10), (8, "a", 90), (7, "a", 110), (6, "a", 10)], "rid int, k string, s long").select("rid", "k", F.timestamp_seconds("s").alias("e"))
    near = {r.id: r.rid for r in joins.nearest(left.drop("s"), right, ["k"], "t", "e", ["rid"], ["rid"], 3_000_000).collect()}
    assert near == {1: 7, 2: 6, 4: 6}
    last = {r.id: r.rid for r in joins.asof_join(left.drop("s"), right, "k", "t", "e", ["rid"], tie=[F.col("rid")], slice_us=3_000_000).collect()}
    assert last == {1: 8, 2: None, 3: None, 4: 6}
