"""Gates, decisions, recommendations and drift at their thresholds; names of teams; nearest rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridspark.functions import teams
from gridspark.operators import grading, joins

BINS = "bin string, min_confidence double, n int, mean_p double, rate double"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([], (False, "no_matching_confidence_bins", 0, "", None)),
        ([("50-55", 0.5, 500, 0.9, 0.1), ("60-65", 0.6, 24, 0.9, 0.1), ("65-70", 0.65, 90, None, 0.1)], (False, "insufficient_high_confidence_sample", 0, "", None)),
        ([("55-60", 0.55, 25, 0.57, 0.501), ("60-65", 0.6, 30, 0.6, 0.9)], (True, "model_confidence_calibration_pass", 2, "", None)),
        ([("55-60", 0.55, 25, 0.58, 0.5), ("60-65", 0.6, 30, 0.7, 0.5), ("65-70", 0.65, 40, 0.7, 0.5), ("70-75", 0.7, 40, 0.7, 0.65)], (False, "blocked_model_confidence_overconfidence", 4, "65-70;60-65;55-60", "65-70")),
    ],
)
def test_a_gate_closes_on_overconfident_bins(spark, rows, want):
    r = grading.confidence_gate(spark.createDataFrame(rows, BINS)).first()
    assert (r["pass"], r.status, r.evaluated_bins, r.failed_bins, r.worst_bin) == want
    assert (r.worst_error is None) == (want[4] is None) and (want[4] is None or r.worst_error == pytest.approx(0.2) and r.worst_recalibrated_prob == 0.5)


SUMMARY = "segment string, strategy string, n int, brier double, log_loss double, auc double, accuracy double, roi double"
BASE = [("all", "current_model", 300, 0.21, 0.61, 0.7, 0.65, 0.0), ("disagree", "current_model", 60, 0.25, 0.7, 0.5, 0.5, -0.02)]


@pytest.mark.parametrize(
    ("strategy", "overall", "disagree", "decision", "layer"),
    [
        ("vegas_novig", (300, 0.20, 0.60, 0.7, 0.5, 0), (60, 0.24, 0.69, 0.5, 0.5, 0.01), "market_reference_beats_model", "benchmark_only"),
        ("vegas_blend_50_50", (250, 0.20, 0.60, 0.7, 0.646, 0), (50, 0.24, 0.69, 0.5, 0.5, 0.01), "market_blend_probability_and_policy_candidate", "market_blend"),
        ("vegas_blend_50_50", (250, 0.20, 0.60, 0.7, 0.646, 0), (49, 0.24, 0.69, 0.5, 0.5, 0.01), "market_blend_probability_research_only", "research"),
        ("confidence_shrink", (250, 0.20, 0.60, 0.7, 0.65, 0), (50, 0.24, 0.69, 0.5, 0.5, 0.01), "base_and_market_candidate", "both"),
        ("confidence_shrink", (250, 0.20, 0.60, 0.7, 0.65, 0), (10, 0.24, 0.69, 0.5, 0.5, -0.02), "base_probability_candidate", "base_model"),
        ("confidence_shrink", (250, 0.20, 0.60, 0.7, 0.6, 0), (10, 0.24, 0.69, 0.5, 0.5, 0.0), "base_probability_research_only", "research"),
        ("confidence_shrink", (250, 0.20, 0.60, 0.7, 0.65, 0), (60, 0.24, 0.69, 0.5, 0.5, -0.03), "base_probability_research_only", "research"),
        ("disagreement_shrink", (249, 0.20, 0.60, 0.7, 0.65, 0), (60, 0.24, 0.69, 0.5, 0.5, 0.01), "market_policy_only_candidate", "market_policy"),
        ("disagreement_shrink", (300, 0.22, 0.60, 0.7, 0.65, 0), (60, 0.26, 0.69, 0.5, 0.5, 0.01), "no_live_change", "none"),
        ("confidence_shrink", (250, 0.20, 0.60, 0.7, 0.65, 0), None, "base_probability_candidate", "base_model"),
    ],
)
def test_both_gates_decide_the_layer(spark, strategy, overall, disagree, decision, layer):
    f = lambda segment, v: (segment, strategy, v[0], *map(float, v[1:]))
    rows = [*BASE, f("all", overall), *([f("disagree", disagree)] if disagree else [])]
    out = {r.strategy: r for r in grading.recalibration_decision(spark.createDataFrame(rows, SUMMARY)).collect()}
    assert len(out) == 4 and (out[strategy].decision, out[strategy].recommended_layer) == (decision, layer)
    assert out[strategy].overall_auc_delta == pytest.approx(0) and all(out[s].decision == "no_live_change" and out[s].overall_n == 0 for s in out if s != strategy)


def test_no_summary_no_change(spark):
    out = grading.recalibration_decision(spark.createDataFrame([], SUMMARY)).collect()
    assert len(out) == 4 and {r.recommended_layer for r in out} == {"none"}


SEGMENTS = "family string, segment string, season int, n int, model_roi double, market_roi double, blend_n int, blend_roi double"


def test_recommendations_need_seasons_and_a_gain_on_the_market(spark):
    rows = []

    def add(segment, whole, seasons, family="side"):
        rows.append((family, segment, None, *whole))
        rows.extend((family, segment, 2020 + i, *s) for i, s in enumerate(seasons))

    good, bad = (9, 0.1, 0.0, 0, None), (9, -0.1, 0.0, 0, None)
    add("model", (27, 0.1, 0.05, 0, None), [good, good, bad])  # two of three seasons, 0.67
    add("half", (27, 0.1, 0.05, 0, None), [good, bad])  # half is below 0.55
    add("one", (27, 0.1, 0.05, 0, None), [good, (4, 0.1, 0.0, 0, None)])  # one season of enough games
    add("market", (27, 0.1, 0.2, 25, 0.3), [good, good])  # gains, but less than the market; the blend beats both
    add("few", (24, 0.1, 0.0, 0, None), [good, good])
    add("loses", (40, -0.1, -0.05, 0, None), [bad])
    add("watch", (40, -0.1, -0.2, 0, None), [])
    add("followed", (40, 0.1, 0.0, 0, None), [good, good], "blend_followed")
    out = {r.segment: r for r in grading.recommendations(spark.createDataFrame(rows, SEGMENTS)).collect()}
    assert {s: r.action.split("_segment")[0] for s, r in out.items()} == {
        "model": "candidate_model_side", "half": "monitor", "one": "monitor", "market": "candidate_market_blend", "loses": "avoid_model_side", "watch": "monitor",
    }
    assert {out[s].tier for s in ("model", "market")} == {"research"} and out["loses"].tier == "block" and out["loses"].score == pytest.approx(0.15)
    assert out["market"].score == pytest.approx(0.5) and out["watch"].seasons == 0 and out["watch"].score == pytest.approx(0.1)


def test_drift_is_absolute_and_has_two_levels(spark):
    now = spark.createDataFrame([("a", 0.25, 0.1), ("b", 0.19, None), ("c", 0.2205, 0.18)], "k string, brier double, max_error double")
    then = spark.createDataFrame([("a", 0.20, 0.1), ("b", 0.2201, 0.1), ("c", 0.2200, 0.1)], "k string, brier double, max_error double")
    out = {(r.k, r.metric): (r.severity, r.drift) for r in grading.drift(now, then, ["k"], {"brier": 0.02, "max_error": 0.04}).collect()}
    assert out["a", "brier"] == ("critical", pytest.approx(0.05)) and out["b", "brier"] == ("warning", pytest.approx(-0.0301)) and out["c", "brier"][0] == "none"
    assert out["a", "max_error"][0] == "none" and out["b", "max_error"] == ("none", None) and out["c", "max_error"][0] == "warning"


def test_whole_names_of_teams(spark):
    names = {
        "San Francisco Giants": None, "Winnipeg Jets": None, "Any Old Team": None, "Washington Football Team": "WAS", "Oakland Raiders": "LV", "Los Angeles Raiders": "LV",
        "LA Rams": "LAR", "LA Chargers": "LAC", "NY Giants": "NYG", "NY Jets": "NYJ", "GNB Packers": "GB", "KC Chiefs": "KC", "KAN Chiefs": "KC", "JAX Jaguars": "JAX", "SF 49ers": "SF", "NWE Patriots": None, "kc chiefs": None, "": None,
    }
    df = spark.createDataFrame([*[(n,) for n in names], (None,)], "n string")
    got = {r.n: r.t for r in df.select("n", teams.from_name(F.col("n")).alias("t")).collect()}
    assert got == names | {None: None} and len(teams.NAMES) == 39 and len(teams.SHORT) == 41


def test_nearest_keeps_equal_rows_and_does_not_number_them(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    left = spark.createDataFrame([("a", at(5), 1), ("a", at(5), 1), ("a", at(9), 2), ("b", at(1), 3), ("a", None, 4)], "k string, t timestamp, n int")
    right = spark.createDataFrame([("a", at(4), "x"), ("a", at(6), "w"), ("a", at(12), "z")], "k string, s timestamp, v string")
    out = sorted((r.n, r.v, r.distance // 3_600_000_000) for r in joins.nearest(left.repartition(5, F.rand()), right, ["k"], "t", "s", ["v"], ["v"]).collect())
    assert out == [(1, "w", 1), (1, "w", 1), (2, "w", 3)]
