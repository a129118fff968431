"""Players' markets and reports on small frames: nulls, ties, pushes, missing columns."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import odds
from gridspark.operators import evaluation, grading, props
from gridspark.sources import feeds

LABELS = "season string, week int, game_id string, team string, opponent string, player_id string, market string, actual_value string, seen int"


def labels(spark):
    rows = [
        ("2023", w, f"2023_{w}_KC_JAC", "JAC", "KC", " p1 ", "RB_Rushing_Yards", str(v) if v is not None else None, 1)
        for w, v in ((1, 10), (2, 0), (3, 40), (4, 50))
    ]
    rows += [
        ("2023", 1, "2023_1_KC_JAC", "JAX", "KC", "p1", "rb_rushing_yards", "30", 2),  # the same key, seen later
        ("2023", 1, "2023_1_KC_JAC", "KC", "JAC", "p2", "rb_rushing_yards", "7", 1),
        ("2023", 2, "x", "JAC", "JAX", "p3", "rb_rushing_yards", "1", 1),  # a team against itself
        ("2023", 2, "x", "JAC", "KC", "p3", "kicks", "1", 1),  # no such market
        ("2023", 2, "x", "JAC", "KC", "p3", "rb_rushing_yards", "n/a", 1),  # no number
        (None, 2, "x", "JAC", "KC", "p3", "rb_rushing_yards", "1", 1), ("2023", 2, "x", "JAC", None, "p3", "rb_rushing_yards", "1", 1), ("2023", 2, " ", "JAC", "KC", "p3", "rb_rushing_yards", "1", 1),
    ]
    return spark.createDataFrame(rows, LABELS)


def test_labels_are_cleaned_and_the_last_counts(spark):
    out = {(r.player_id, r.week): r for r in props.prepare_labels(labels(spark), ["rb_rushing_yards"], "seen").collect()}
    assert set(out) == {("p1", 1), ("p1", 2), ("p1", 3), ("p1", 4), ("p2", 1)}
    assert out["p1", 1].actual_value == 30 and out["p1", 1].team == "JAX" and out["p1", 1].market_family == "rushing" and not out["p1", 2].actual_over_zero
    early = props.prepare_labels(labels(spark), ["rb_rushing_yards"], "seen", before=(2023, 2))
    assert {r.week for r in early.collect()} == {1}


def test_features_look_back_only(spark):
    out = {(r.player_id, r.week): r for r in props.features(props.prepare_labels(labels(spark), ["rb_rushing_yards"], "seen")).collect()}
    r = out["p1", 4]
    assert (r.player_games_prior, r.player_last1_value, r.player_last3_avg, r.player_over_zero_rate_prior) == (3, 40.0, pytest.approx(70 / 3), pytest.approx(2 / 3))
    assert r.player_std_prior == pytest.approx(20.8167, abs=1e-4) and r.team_market_weekly_total_avg_prior == pytest.approx(70 / 3) and r.opponent_allowed_players_avg_prior == 1
    assert r.is_home and not r.is_away and out["p2", 1].is_away
    first = out["p1", 1]
    assert first.player_games_prior == 0 and first.player_avg_prior is None and first.team_market_weekly_mean_avg_prior is None


def test_candidates_see_the_labels_before_them(spark):
    known = props.prepare_labels(labels(spark), ["rb_rushing_yards"], "seen")
    asked = labels(spark).filter("player_id LIKE '%p1%' AND week = 4").withColumns({"season": F.lit("2023"), "week": F.lit(5), "game_id": F.lit("odd")})
    out = props.features(known, props.prepare_candidates(asked, ["rb_rushing_yards"], "seen")).collect()
    assert len(out) == 1 and out[0].player_games_prior == 4 and out[0].player_avg_prior == 30 and out[0].actual_value is None and out[0].value_type == "yards"
    assert out[0].is_home is None and out[0].active and not out[0].played
    assert props.features(known, props.prepare_candidates(asked.limit(0), ["rb_rushing_yards"], "seen")).collect() == []


def test_probability_input_leaves_pushes_out(spark):
    rows = spark.createDataFrame([("2023", "1", " m ", "5.5", "6", "7"), ("2023", "1", "m", "7", "6", "7"), ("2023", "1", "m", None, "6", "7"), ("x", "1", "m", "1", "6", "7")], "season string, week string, market string, line string, model_projection string, actual_value string")
    (r,) = props.probability_input(rows).collect()
    assert (r.market, r.residual, r.actual_over_line, r.model_edge) == ("m", 1.0, True, 0.5)


def test_bounds_keep_nulls(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (3.0,)], "x double")
    assert [r.y for r in df.select(odds.held(F.col("x"), 0.0, 1.0).alias("y")).collect()] == [None, 0.0, 0.5, 1.0]
    assert [r.y for r in df.select(odds.log_loss(F.col("x"), F.lit(1)).alias("y")).collect()][0] is None


def test_a_missing_probability_scores_nothing(spark):
    rows = [("a", True, 0.8, 0.5, 1, "residual_cdf"), ("a", False, 0.4, None, -1, "residual_cdf"), ("b", True, 0.9, None, 0, "base_rate_fallback")]
    out = {r.market: r for r in props.over_probability_summary(spark.createDataFrame(rows, "market string, actual_over_line boolean, prob_over_model double, prob_over_market double, model_edge int, method string")).collect()}
    assert out["all"].n == 3 and out["all"].market_brier == pytest.approx(0.25) and out["b"].market_brier is None and out["b"].market_auc is None
    assert out["a"].model_auc == 1 and out["a"].projection_pick_accuracy == 1 and out["b"].projection_pick_accuracy is None and out["all"].residual_cdf_rows == 2


def test_tiers_by_known_history_else_own_size(spark):
    keys = "season int, week int, game_id string, team string, player_id string, market string"
    key = (2023, 1, "g", "A")
    rows = spark.createDataFrame([(*key, "p1", "m", 50), (*key, "p2", "m", 5), (*key, "p3", "m", None)], f"{keys}, sample_size int")
    history = spark.createDataFrame([(*key, "p1", "m", 19, 1), (*key, "p1", "m", 20, 2)], f"{keys}, player_games_prior int, seen int")
    assert {r.player_id: (r.sample_size, r.confidence_tier) for r in props.attach_tiers(rows, history, "seen").collect()} == {"p1": (20, "high"), "p2": (5, "medium"), "p3": (0, "low")}


def test_roster_audit_ladder(spark):
    predictions = spark.createDataFrame([(1, "g", "m", "n1", None, " DK ", 1.5), (2, "g", "m", "n2", "unknown", None, None), (3, "g", "none", "n1", "unknown", "dk", 1.5), (4, "g", "m", "n1", "ok", "dk", 1.5)], "row int, game_id string, market string, name_key string, roster_flag string, sportsbook string, line double")
    raw = spark.createDataFrame([("m", "dk"), ("m", "FD "), ("m", "mgm")], "market string, sportsbook string")
    prepared = spark.createDataFrame([("g", "m", "n1", "fd"), ("g", "m", "n1", "dk"), ("h", "m", "n2", "dk")], "game_id string, market string, name_key string, sportsbook string")
    out = {(r.row, r.sportsbook): r.line_availability_status for r in props.roster_line_audit(predictions, raw, prepared, ["DK", "fd", "mgm"], ["unknown"]).collect()}
    assert out == {
        (1, "dk"): "published", (1, "fd"): "matchable_not_published", (1, "mgm"): "raw_unprepared", (2, "dk"): "no_matching_line", (2, "fd"): "no_matching_line", (2, "mgm"): "raw_unprepared",
        (3, "dk"): "published", (3, "fd"): "vendor_no_rows", (3, "mgm"): "vendor_no_rows",
    }


def test_projections_without_labels_stay(spark):
    keys = "season int, week int, game_id string, team string, player_id string, market string"
    made = spark.createDataFrame([(1, 1, "g", "A", "p", "anytime_td", -0.5), (1, 1, "g", "A", "q", "anytime_td", 1.0), (1, 1, "g", "A", "q", "yards", 9.0)], f"{keys}, projection double")
    known = spark.createDataFrame([(1, 1, "g", "A", "q", "anytime_td", 2.0)], f"{keys}, actual_value double")
    out = sorted((r.player_id, r.market, r.label_available, r.error, r.prob_over_zero) for r in props.labels_to_projections(known, made).collect())
    assert out == [("p", "anytime_td", False, None, 0.0), ("q", "anytime_td", True, -1.0, pytest.approx(1 - math.exp(-1))), ("q", "yards", False, None, None)]


GAME = "game_id string, season int, week int, home_team string, away_team string, home_win_prob double, pred_home_margin double, made_at int"


def decided(spark):
    rows = [("a", 1, 1, "X", "Y", 0.2, 1.0, 1), ("a", 1, 1, "X", "Y", 0.7, 3.0, 2), ("b", 1, 1, "Y", "X", 1.5, -4.0, 1), ("c", 1, 1, "X", "Z", 0.6, 0.0, 1), ("d", 1, 1, "X", "Z", None, None, 1)]
    actuals = spark.createDataFrame([("a", 7.0), ("b", -10.0), ("c", 0.0), ("d", 3.0), ("e", 1.0)], "game_id string, home_margin double")
    return evaluation.decided(spark.createDataFrame(rows, GAME), actuals, ["game_id"], "made_at")


def test_the_last_prediction_of_decided_games_is_graded(spark):
    out = {r.game_id: r for r in decided(spark).collect()}
    assert set(out) == {"a", "b", "d"} and out["a"].home_win_prob == 0.7 and not out["a"].misclassified and out["b"].home_win_prob == 1 and out["b"].misclassified
    assert out["b"].log_loss_component == pytest.approx(-math.log(1e-9)) and out["d"].prob_error_sq is None and out["d"].misclassified is None
    (m,) = evaluation.metrics([], decided(spark)).collect()
    assert m.n_games == 3 and m.accuracy == 0.5 and m.mae_margin == 5.0 and m.auc == 0.0
    teams = {r.team: (r.n_games, r.misclassified_rate) for r in evaluation.team_errors(decided(spark)).collect()}
    assert teams == {"X": (3, 0.5), "Y": (2, 0.5), "Z": (1, None)}
    bins = evaluation.probability_bins(decided(spark)).orderBy("bin").collect()
    assert [b.n_games for b in bins] == [0, 0, 0, 0, 0, 0, 1, 0, 0, 1] and bins[6].mean_margin_error == -4.0
    assert {(r.game_id, r.report) for r in evaluation.worst(decided(spark), 1).collect()} == {("b", "margin"), ("b", "confidence")}


def test_market_and_model_meet_on_the_same_games(spark):
    rows = spark.createDataFrame([("a", 1, 3, 7.0, 0.8), ("b", 1, 3, -3.0, 0.3), ("c", 1, None, 3.0, 0.9), ("d", 1, 20, 0.0, 0.9), ("e", 2, 20, 5.0, None), ("f", 2, 20, 5.0, 0.7)], "game_id string, season int, week int, home_margin double, p double")
    prices = spark.createDataFrame([("a", 0.6, 0.5, 1), ("a", 0.66, 0.44, 2), ("b", 0.5, 0.5, 1), ("c", None, 0.5, 1), ("e", 0.5, 0.5, 1), ("f", 0.5, 0.5, 1)], "game_id string, implied_home double, implied_away double, seen int")
    out = {(r.source, r.season, r.week_bucket): r for r in evaluation.against_market(evaluation.attach_market(rows, prices, "seen"), ["p"]).collect()}
    assert {k[1:] for k in out} == {("all", "all"), ("1", "all"), ("2", "all"), ("all", "early"), ("all", "playoffs")}
    r = out["p", "all", "all"]
    assert r.n_games == 3 and r.brier == pytest.approx((0.04 + 0.09 + 0.09) / 3) and r.brier_minus_market == pytest.approx(r.brier - (0.16 + 0.25 + 0.25) / 3) and out["market_prob", "1", "all"].brier_minus_market == 0
    assert out["p", "2", "all"].auc is None


def test_matrix_of_a_game_about_which_nothing_is_known(spark):
    (r,) = evaluation.volatility_matrix(spark.createDataFrame([("g", None)], "game_id string, home_win_prob double"), ["game_id"]).collect()
    on = {c for c in r.asDict() if c != "game_id" and r[c] != 0}
    assert on == {"outdoor_game"} and len(r) == 42
    (r,) = evaluation.volatility_matrix(spark.createDataFrame([("g", 0.9, "x", 5.0, None, True, 14.0)], "game_id string, home_win_prob double, wind string, home_rest double, away_rest double, roof_is_dome boolean, pred_home_margin double"), ["game_id"]).collect()
    assert r.short_rest == 1 and r.indoor_game == 1 and r.wind_mph == 0 and r.rest_diff == 0 and r.model_uncertainty == pytest.approx(0.2) and r.pred_margin_confidence == pytest.approx(math.tanh(1))


def test_volatile_games_are_drawn_to_the_line(spark):
    rows = spark.createDataFrame([("a", 0.9, 10.0, 0.5, 0.6, 0.6, -4.0), ("b", 0.9, 10.0, 0.49, 0.6, 0.6, -4.0), ("c", 0.9, 10.0, 1.0, None, 0.5, None), ("d", 0.9, None, None, 0.6, 0.6, -4.0)], "game_id string, home_win_prob double, pred_home_margin double, volatility_prob double, implied_home double, implied_away double, spread_close_home double")
    out = {r.game_id: (r.home_win_prob, r.pred_home_margin, r.volatile) for r in evaluation.shrink_volatile(rows, 0.5, 0.8, 2.0).collect()}
    assert out == {"a": (pytest.approx(0.5 + 0.4 * 0.6), pytest.approx(-4 + 14 * 0.5), 1), "b": (0.9, 10.0, 0), "c": (pytest.approx(0.5 + 0.4 * 0.2), 0.0, 1), "d": (0.9, None, 0)}


def test_windows_of_games_seasons_and_columns(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    games = spark.createDataFrame([(1, at(1), 2001), (2, at(3), 2005), (3, None, 2010), (4, at(2), None)], "n int, t timestamp, season int")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert {r.n for r in evaluation.unstarted(games, now, F.col("t")).collect()} == {2, 3}
    assert {r.n for r in evaluation.supported_seasons(games, "season", 2002, 2010).collect()} == {2, 3} and evaluation.supported_seasons(games, "season").count() == 4
    assert evaluation.same_columns(games, games.drop("t").withColumn("z", F.lit(1))) == (["n", "season"], [["t"], ["z"]])
    stored = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c")], "season int, week int, v string")
    new = spark.createDataFrame([(1, 1, "n", 5)], "season int, week int, v string, more int")
    assert {r.v for r in evaluation.replace_week(stored, new, 1, 1).collect()} == {"b", "c", "n"} and {r.v for r in evaluation.replace_week(stored, new.limit(0), 1, 1).collect()} == {"b", "c"}
    news = spark.createDataFrame([("2022-06-01",), ("2024-03-01T00:00:00",), ("2022-05-31",), ("soon",), (None,)], "published string")
    assert {r.published for r in feeds.in_season(news, 2023).collect()} == {"2022-06-01", "2024-03-01T00:00:00"}


def test_injuries_of_broken_and_empty_payloads(spark):
    rows = [(1, '{"injuries": [{"type": "Knee", "athlete": {"id": "7", "displayName": "Al"}}, {"status": "Out", "type": "X", "team": {"abbreviation": "KC"}}]}'), (2, "{"), (3, None), (4, '{"injuries": []}')]
    out = [(r.week, r.team, r.id, r.injury_status) for r in feeds.injuries(spark.createDataFrame(rows, "week int, payload string")).collect()]
    assert out == [(1, None, "7", "Knee"), (1, "KC", None, "Out")]


def test_a_grade_without_a_probability(spark):
    p = spark.createDataFrame([(1, None, 2.0, -110.0, 100.0)], "g int, home_win_prob double, pred_home_margin double, home_moneyline double, away_moneyline double")
    r = grading.versus_actual(p, spark.createDataFrame([(1, 3.0, True)], "g int, home_margin double, actual_home_win boolean"), ["g"]).first()
    assert r.home_win_prob is None and r.brier_component is None and r.su_result == "ungraded"
