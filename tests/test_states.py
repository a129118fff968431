"""Folds through time: exponential means with gaps, strengths, quarterbacks."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import quarterbacks, sequential, windows

GAPS = [1, None, None, 4, 2, 9, None, 3, None, None, None, 5]


@pytest.mark.parametrize("span", [2, 3, 8])
@pytest.mark.parametrize("prior", [True, False])
@pytest.mark.parametrize("series", [GAPS, [None, None, *GAPS], [None] * 4, [7], [random.Random(1).choice([None, i / 7]) for i in range(300)]])
def test_exponential_means_equal_pandas(spark, span, prior, series):
    rows = [("a", i, None if v is None else float(v)) for i, v in enumerate(series)] + [("b", 0, 3.0), ("b", 1, 5.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = [r.e for r in windows.ewm(df, "v", ["k"], ["t"], span, "e", prior).filter("k = 'a'").orderBy("t").collect()]
    s = pd.Series([r[2] for r in rows if r[0] == "a"], dtype=float)
    want = (s.shift(1) if prior else s).ewm(span=span, adjust=False).mean()
    assert [None if math.isnan(x) else pytest.approx(x, rel=1e-12) for x in want] == got


def test_rows_since_a_flag(spark):
    df = spark.createDataFrame([("a", i, i in (2, 5)) for i in range(9)], "k string, t int, f boolean")
    got = [r.n for r in windows.rows_since(df, F.col("f"), ["k"], ["t"], 3, "n").orderBy("t").collect()]
    assert got == [3, 3, 3, 0, 1, 2, 0, 1, 2]


def league(seed, seasons=3, weeks=7, teams="ABCDEF"):
    rng = random.Random(seed)
    out = []
    for s in range(2018, 2018 + seasons):
        for w in range(1, weeks + 1):
            names = rng.sample(teams, rng.choice([2, 4, 6]))
            for i in range(0, len(names), 2):
                scores = (rng.randint(0, 40), rng.randint(0, 40)) if rng.random() < 0.85 else (None, rng.choice([None, 7]))
                scores = (scores[1], scores[1]) if rng.random() < 0.1 else scores
                epa = [round(rng.uniform(-1, 1), 3) if rng.random() < 0.7 else None for _ in range(2)]
                out.append((seed % 2, s, w, f"{s}_{w:02d}_{i}", names[i], names[i + 1], *scores, *epa))
    out.append((seed % 2, 2019, 3, "2019_03_9", out[0][4], out[0][5], 30, 3, 0.5, None))  # a side plays twice in a week
    return out


SCHEMA = "l int, season int, week int, game_id string, home string, away string, home_score double, away_score double, home_epa double, away_epa double"


def strengths(games):
    """The same by one pass over one league's games, each column on its own."""
    elo, games_of, last, form, total = {}, {}, {}, {}, {}
    rows = {}
    weeks = sorted({(g[1], g[2]) for g in games})
    for season, week in weeks:
        now = sorted((g for g in games if (g[1], g[2]) == (season, week)), key=lambda g: g[3:6])
        for g in now:
            shown = []
            for t in g[4:6]:
                if last.get(t, season) != season:
                    elo[t] = 1505 + (elo.get(t, 1505) - 1505) * 2 / 3
                    games_of[t] = 0
                    for c in ("pd", "off", "def"):
                        if (t, c) in form:
                            n, mean = total.get(c, (0, form[t, c]))
                            form[t, c] = mean + (form[t, c] - mean) / 2
                last[t] = season
                means = [form.get((t, c), total.get(c, (0, None))[1]) for c in ("pd", "off", "def")]
                shown += [elo.get(t, 1505.0), *means, games_of.get(t, 0)]
            rows[g[3]] = shown
        for g in now:
            home, away, hs, as_, he, ae = g[4:10]
            if hs is None or as_ is None:
                continue
            edge = elo.get(home, 1505) + 48 - elo.get(away, 1505)
            expected = 1 / (1 + 10 ** (-edge / 400))
            if hs != as_:
                m = math.log(abs(hs - as_) + 1) * 2.2 / ((edge if hs > as_ else -edge) * 0.001 + 2.2)
                d = 20 * m * ((hs > as_) - expected)
                elo[home], elo[away] = elo.get(home, 1505) + d, elo.get(away, 1505) - d
            for t, values in ((home, {"pd": hs - as_, "off": he, "def": ae}), (away, {"pd": as_ - hs, "off": ae, "def": he})):
                games_of[t] = games_of.get(t, 0) + 1
                for c, v in values.items():
                    if v is not None:
                        n, mean = total.get(c, (0, 0.0))
                        total[c] = (n + 1, (mean * n + v) / (n + 1))
                        a = 1 - 0.5 ** (1 / 8)
                        form[t, c] = v if (t, c) not in form else (1 - a) * form[t, c] + a * v
    return rows


@pytest.mark.parametrize("weeks_a_job", [1, 5, 52])
def test_strengths_equal_a_plain_fold(spark, weeks_a_job):
    games = league(0, 2 if weeks_a_job == 1 else 3) + league(1, 2)
    lost = [(0, None, 1, "x", "A", "B", 1, 2, None, None), (0, 2019, 1, "y", None, "B", 1, 2, None, None)]
    df = spark.createDataFrame([tuple(float(x) if i > 5 and x is not None else x for i, x in enumerate(g)) for g in games + lost], SCHEMA)
    out = sequential.team_strength(df, "l", weeks_a_job).collect()
    names = [f"{c}_{side}" for side in ("home", "away") for c in sequential.STRENGTHS]
    got = {(r.league, r.game_id): [r[c] for c in names] for r in out}
    assert len(out) == len(games) + 2 and all(v is None for key in ((0, "x"), (0, "y")) for v in got.pop(key))
    want = {(n, k): v for n in (0, 1) for k, v in strengths([g for g in games if g[0] == n]).items()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == [None if x is None else pytest.approx(x, abs=1e-9) for x in v], k


def test_strengths_see_no_result_of_their_week_or_later(spark):
    games = league(0)
    later = [g[:6] + (60, 0, 5.0, -5.0) if (g[1], g[2]) >= (2019, 3) else g for g in games]
    seen = []
    for rows in (games, later):
        df = spark.createDataFrame([tuple(float(x) if i > 5 and x is not None else x for i, x in enumerate(g)) for g in rows], SCHEMA)
        out = sequential.team_strength(df, "l").filter("season < 2019 OR season = 2019 AND week <= 3")
        seen.append(sorted(map(str, out.collect())))
    assert seen[0] == seen[1]


def test_no_games_no_strengths(spark):
    assert sequential.team_strength(spark.createDataFrame([], SCHEMA), "l").collect() == []


def test_elo_does_not_depend_on_the_size_of_jobs(spark):
    df = spark.createDataFrame([tuple(float(x) if i > 5 and x is not None else x for i, x in enumerate(g)) for g in league(0) + league(1)], SCHEMA)
    a, b = (sorted(map(tuple, sequential.elo(df, "l", weeks_a_job=n).collect())) for n in (3, 52))
    assert a == b and len(a) > 50


def test_quarterbacks(spark):
    schedule = spark.createDataFrame(
        [(2023, w, f"g{w}", "A", "B", " Joe Doe ", "11" if w < 3 else None, "Sam Poe", None) for w in range(1, 5)] + [(2023, 5, "g5", "A", None, "x", None, None, None), (None, 6, "g6", "A", "B", "x", None, None, None)],
        "season int, week int, game_id string, home_team string, away_team string, home_qb_name string, home_qb_id string, away_qb_name string, away_qb_id string",
    )
    injuries = spark.createDataFrame(
        [(2023, 1, "A", "QB", "joe doe", "11", "Questionable", "DNP"), (2023, 1, "A", "QB", "joe doe", "11", "Out", None), (2023, 2, "A", "qb", "JOE DOE", None, "Doubtful", None),
         (2023, 3, "Z", "QB", "other", "77", None, "Limited"), (2023, 1, "B", "WR", "sam poe", None, "Out", None)],
        "season int, week int, team string, position string, player_name string, player_id string, status string, practice string",
    )
    roster = spark.createDataFrame([("A", "joe doe", "77"), ("A", "Joe Doe", "78"), ("B", None, "5")], "team string, full_name string, gsis_id string")
    out = {(r.team, r.week): r for r in quarterbacks.quarterback_health(schedule, injuries, roster).collect()}
    assert len(out) == 8
    a = [out["A", w] for w in range(1, 5)]
    assert [r.qb_player_id for r in a] == ["11", "11", "77", "77"]
    assert [r.qb_status_flag for r in a] == [2.0, 1.5, 0.5, 0.0]  # worst by id; by name; by the roster's id; none
    assert [r.qb_status_delta_rolling3 for r in a] == [0.0, -0.5, -1.25, pytest.approx(-4 / 3)]
    assert [r.qb_missed_last_game for r in a] == [0, 1, 1, 0] and [r.qb_games_started_rolling5 for r in a] == [1, 2, 3, 4]
    assert [r.qb_recovery_score_rolling3 for r in a] == [0.0, 2.0, 1.75, 1.125] and [r.qb_weeks_since_injury for r in a] == [8, 0, 0, 1]
    assert all(out["B", w].qb_status_flag == 0 for w in range(1, 5))
