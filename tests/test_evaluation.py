"""Calibration layers, bootstrap and walk-forward models against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import aggregates, calibrate, walkforward


def plain_isotonic(x, y):
    """Least-squares non-decreasing levels at the distinct x, by the max-min formula."""
    at = sorted(set(x))
    s = [sum(b for a, b in zip(x, y, strict=True) if a == v) for v in at]
    c = [sum(a == v for a in x) for v in at]
    mean = lambda i, j: sum(s[i : j + 1]) / sum(c[i : j + 1])
    return at, [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]


def seasons(seed, rows=400, scores=37):
    rng = random.Random(seed)
    out = []
    for s in range(2015, 2021):
        for _ in range(rows):
            p = round(rng.randrange(scores + 1) / scores, 6)
            out.append((s, p, int(rng.random() < 0.2 + 0.6 * p**2)))
    return out


@pytest.mark.parametrize("slices", [1, 7, 256])
def test_isotonic_levels_are_exact(spark, slices):
    rows = [r for r in seasons(3, 120) if r[0] < 2017]
    counts = spark.createDataFrame(rows, "season int, p double, y int").groupBy("season", "p").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("c"))
    blocks = calibrate.isotonic(counts, "season", slices=slices)
    asked = spark.createDataFrame([(s, i / 200) for s in (2015, 2016) for i in range(-5, 206)], "season int, p double")
    got = calibrate.apply_isotonic(asked, blocks, "season", "p", "q").collect()
    assert len(got) == 2 * 211
    for s in (2015, 2016):
        at, level = plain_isotonic([r[1] for r in rows if r[0] == s], [r[2] for r in rows if r[0] == s])
        for r in got:
            if r.season == s:
                assert r.q == pytest.approx(np.interp(r.p, at, level), abs=1e-9)


def test_pooling_parts_first_changes_nothing():
    rng = random.Random(5)
    for _ in range(50):
        blocks = [(i, i, rng.randint(0, 3), 3) for i in range(40)]
        cuts = sorted(rng.sample(range(41), 4))
        parts = [b for lo, hi in zip([0, *cuts], [*cuts, 40], strict=True) for b in calibrate.pool(blocks[lo:hi])]
        assert calibrate.pool(blocks) == calibrate.pool(parts)


def plain_sigmoid(x, y):
    mean, sd = np.mean(x), np.std(x) or 1.0
    d = np.column_stack([np.ones(len(x)), (np.array(x) - mean) / sd])
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-d @ b))
        step = np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + np.diag([0, 1.0]), d.T @ (p - y) + np.array([0, b[1]]))
        b = b - step
    return lambda q: 1 / (1 + np.exp(-(b[0] + b[1] * (np.array(q) - mean) / sd)))


@pytest.mark.parametrize("gain", [0.0005, 0.5])
def test_selection_equals_refitting_each_season(spark, gain):
    rows = [*seasons(8), (None, 0.5, 1), (2019, None, 1), (2030, 0.4, 1)]
    out = {r.method: r for r in calibrate.select_calibration(spark.createDataFrame(rows, "s int, p double, y int"), "p", "y", "s", 2, 700, gain).collect()}
    told = {m: [] for m in calibrate.METHODS}
    for s in range(2017, 2021):
        train, test = ([r for r in rows if None not in r and a <= r[0] < b] for a, b in ((s - 2, s), (s, s + 1)))
        x, y = [r[1] for r in train], np.array([r[2] for r in train])
        q = [r[1] for r in test]
        for m, v in (("none", q), ("sigmoid", plain_sigmoid(x, y)(q)), ("isotonic", np.interp(q, *plain_isotonic(x, list(y))))):
            told[m] += list(zip(np.clip(v, 1e-6, 1 - 1e-6), [r[2] for r in test], strict=True))
    brier = {m: np.mean([(p - y) ** 2 for p, y in v]) for m, v in told.items()}
    for m, v in told.items():
        assert out[m].brier == pytest.approx(brier[m], abs=1e-9) and out[m].n_games == 1600 and out[m].n_seasons == 4
        assert out[m].log_loss == pytest.approx(-np.mean([y * math.log(p) + (1 - y) * math.log(1 - p) for p, y in v]), abs=1e-9)
    best = min(brier, key=brier.get)
    assert best != "none"
    assert [m for m in out if out[m].selected] == [best if gain < 0.1 else "none"]


def test_selection_without_enough_seasons(spark):
    for rows in ([], [(2020, 0.5, 1), (2021, 0.6, 1)]):
        out = calibrate.select_calibration(spark.createDataFrame(rows, "s int, p double, y int"), "p", "y", "s", 2).collect()
        assert [r.method for r in out if r.selected] == ["none"] and all(r.brier is None and r.n_games == 0 for r in out)


def area(score, y, w):
    order = np.argsort(score, kind="stable")
    score, y, w = score[order], y[order], w[order]
    total = below = 0.0
    for v in np.unique(score):
        at = score == v
        neg = w[at & (y == 0)].sum()
        total += w[at & (y == 1)].sum() * (below + neg / 2)
        below += neg
    return total / (w[y == 1].sum() * w[y == 0].sum())


def test_bootstrap_of_areas(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 900)
    a = np.round(np.clip(0.35 * y + rng.random(900) * 0.7, 0, 1), 2)
    b = np.round(np.clip(0.2 * y + rng.random(900) * 0.8, 0, 1), 2)
    a[:300] = 0.5  # one score holds a third of the rows
    df = spark.createDataFrame([(i, float(p), float(q), int(t)) for i, (p, q, t) in enumerate(zip(a, b, y, strict=True))] + [(900, None, 0.5, 1)], "i int, a double, b double, y int")
    r = aggregates.bootstrap_auc(df.repartition(5), ["i"], "a", "b", "y", 400).first()
    one = np.ones(900)
    assert r.auc_a == pytest.approx(area(a, y, one)) and r.auc_b == pytest.approx(area(b, y, one)) and r.gap == pytest.approx(r.auc_a - r.auc_b)
    drawn = []
    for _ in range(400):
        at = rng.integers(0, 900, 900)
        drawn.append(area(a[at], y[at], one) - area(b[at], y[at], one))
    assert r.sd == pytest.approx(np.std(drawn), rel=0.2) and r.mean_gap == pytest.approx(np.mean(drawn), abs=4 * r.sd / 20)
    assert r.z == pytest.approx(r.mean_gap / r.sd) and r.p_value == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-6)
    again = aggregates.bootstrap_auc(df.repartition(2), ["i"], "a", "b", "y", 400).first()
    assert again.sd == pytest.approx(r.sd, abs=1e-12)
    weights = aggregates._poisson(np.arange(2000), 50)
    assert (weights[:, 0] == 1).all() and abs(weights[:, 1:].mean() - 1) < 0.02 and abs(weights[:, 1:].var() - 1) < 0.03


def test_bootstrap_without_both_outcomes(spark):
    r = aggregates.bootstrap_auc(spark.createDataFrame([(1, 0.5, 0.6, 1)], "i int, a double, b double, y int"), ["i"], "a", "b", "y", 20).first()
    assert r.auc_a is None and r.z == 0 and r.p_value == 1


@pytest.mark.parametrize("cadence", ["week", "season"])
def test_walk_forward_equals_refitting_each_chunk(spark, cadence):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(2018, 2022):
        for w in range(1, 6):
            for g in range(12):
                x = rng.normal(size=2)
                margin = None if rng.random() < 0.1 else float(np.round(3 * x[0] - 2 * x[1] + rng.normal() * 5, 3))
                rows.append((f"{s}-{w}-{g}", s, w, float(x[0]) if g else None, float(x[1]), margin))
    df = spark.createDataFrame(rows, "game_id string, season int, week int, a double, b double, margin double")
    got = {r.game_id: r for r in walkforward.walk_forward_scores(df, ["a", "b"], "margin", cadence, 2019, 30).collect()}
    want = 0
    for s in range(2018, 2022):
        for w in range(1, 6):
            before = [r for r in rows if r[5] is not None and r[1] >= 2019 and (r[1] < s or (cadence == "week" and r[1] == s and r[2] < w))]
            if len(before) < 30:
                continue
            x = np.array([[1, r[3] or 0, r[4]] for r in before])
            y = np.array([r[5] for r in before])
            b = np.linalg.solve(x.T @ x + np.diag([0, 1, 1]), x.T @ y)
            sd = np.sqrt(np.mean((y - x @ b) ** 2))
            for r in (r for r in rows if (r[1], r[2]) == (s, w) and r[5] is not None):
                z = b @ [1, r[3] or 0, r[4]]
                g = got[r[0]]
                want += 1
                assert g.pred_margin == pytest.approx(z, abs=1e-8) and g.win_prob == pytest.approx((1 + math.erf(z / sd / math.sqrt(2))) / 2, abs=1e-6)
                assert (g.train_rows, g.train_start, g.train_end, g.refit_id) == (len(before), 2019, max(q[1] for q in before), w - 1 if cadence == "week" else 0)
    assert want == len(got) > 100
