import uuid

import pytest
from pyspark.sql import functions as F

from gridspark.functions import ids, time
from gridspark.operators import football, market


def test_uuid5(spark):
    df = spark.createDataFrame([("games:2024|1|BUF|MIA",), ("é",), ("",), ("x" * 500,)], "n string")
    for n, u in df.select("n", ids.uuid5(F.col("n"))).collect():
        assert u == str(uuid.uuid5(uuid.NAMESPACE_DNS, n))
    one = spark.createDataFrame([(2024, 1, "LAR", "SF"), (2024, 1, "LA", "SF")], "s int, w int, a string, h string")
    found = [r[0] for r in one.select(ids.game_uid(*map(F.col, "swah"), relaxed=True)).collect()]
    assert found[0] == found[1]


@pytest.mark.parametrize(
    ("day", "clock", "utc"),
    [
        ("2024-01-14", "13:00", "2024-01-14 18:00:00"), ("2024-07-04", "13:00", "2024-07-04 17:00:00"), ("2024-03-10", "02:30", None),
        ("2024-11-03", "01:30", None), ("2024-11-03", "03:00", "2024-11-03 08:00:00"), (None, "13:00", None), ("2024-01-14", "x", None), ("2024-01-14", None, "2024-01-14 17:00:00"),
    ],
)
def test_kickoffs(spark, day, clock, utc):
    df = spark.createDataFrame([(day, clock)], "d string, c string")
    assert df.select(time.kickoff_utc(F.col("d"), F.col("c"), default="12:00").cast("string")).first()[0] == utc


def test_injury_grid_carries_within_a_season(spark):
    games = spark.createDataFrame([(2023, w, "A", "B") for w in (1, 2, 3)] + [(2024, 1, "A", "B")], "season int, week int, home_team string, away_team string")
    reports = spark.createDataFrame([(2023, 1, "A", 2.0), (2023, 3, "B", 1.0)], "season int, week int, team string, inj_out double")
    got = {(r.season, r.week, r.team): r.inj_out for r in football.injury_grid(reports, games, ["inj_out"]).collect()}
    assert got[(2023, 1, "A")] == 2 and got[(2023, 1, "B")] == 0 and got[(2023, 2, "A")] == 2 and got[(2023, 3, "A")] == 0
    assert got[(2024, 1, "A")] is None


def test_severity_takes_the_worse(spark):
    df = spark.createDataFrame([("Questionable", "DNP"), (None, "Limited"), ("Out", None), (None, None)], "s string, p string")
    assert [r[0] for r in df.select(football.injury_severity(F.col("s"), F.col("p"))).collect()] == [0.6, 0.3, 1.0, 0.0]


def test_spread_example(spark):
    df = spark.createDataFrame([(3.5, 1.0, 6.5, 0.6, -271.0, 220.0), (7.0, 7.0, 7.0, 0.6, 0.0, 110.0)], "pred_home_margin double, home_margin double, spread_line double, home_win_prob double, home_moneyline double, away_moneyline double")
    a, b = market.spread_grade(df).collect()
    assert (a.edge_points, a.result_points, a.side, a.grade) == (-3.0, -5.5, "away", "win") and b.grade == "push"
    a, b = market.benchmark(df).collect()
    assert a.home_implied_prob_novig + a.away_implied_prob_novig == pytest.approx(1) and b.home_implied_prob_novig is None and b.model_side_profit is None


def test_picks_lock_before_kickoff(spark):
    rows = [("g", 1, "2024-01-01 10:00"), ("g", 2, "2024-01-01 15:00"), ("g", 3, "2024-01-01 17:00"), ("h", 4, "2024-01-01 17:30"), ("h", 5, "2024-01-01 17:10")]
    df = spark.createDataFrame(rows, "game_id string, n int, t string").select("game_id", "n", F.to_timestamp("t").alias("recorded_at"), F.to_timestamp(F.lit("2024-01-01 18:00")).alias("kickoff"))
    assert {r.game_id: (r.n, r.status) for r in market.picks_of_record(df).collect()} == {"g": (2, "locked"), "h": (5, "late")}


def test_policy_prefers_the_eligible(spark):
    df = spark.createDataFrame([("a", 0.0, 200, 0.01), ("a", 0.1, 10, 0.5), ("b", 0.0, 5, -0.1), ("b", 0.1, 3, 0.2)], "k string, threshold double, bets long, roi double")
    got = {r.k: (r.threshold, r.eligible) for r in market.best_policy(df, ["k"], 100, 0.0).collect()}
    assert got == {"a": (0.0, True), "b": (0.1, False)}
