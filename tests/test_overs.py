"""Chances of overs against a walk through the weeks, and nearest places on the globe."""

import math
import random

import pytest

from gridspark.operators import joins, overs, props


def plain(rows, least, shrink, blend_least):
    """Week by week and market by market, as one would do by hand."""
    clip = lambda x: min(0.98, max(0.02, x))
    out, scored = {}, {}
    for market in {r["market"] for r in rows}:
        mine = sorted((r for r in rows if r["market"] == market and r["v"] != r["line"]), key=lambda r: (r["season"], r["week"]))
        for week in sorted({(r["season"], r["week"]) for r in mine}):
            prior = [r for r in mine if (r["season"], r["week"]) < week]
            last = {}
            for r in sorted(prior, key=lambda r: r["seen"]):
                last[r["season"], r["week"], r["player"]] = r["v"] - r["proj"]
            res = list(last.values())
            base = sum(r["v"] > r["line"] for r in prior) / len(prior) if prior else 0.5
            before = [s for s in scored.get(market, []) if s[0] is not None and s[1] is not None]
            for r in (r for r in mine if (r["season"], r["week"]) == week):
                pm = None if r["ip"] is None else clip(r["ip"])
                if len(res) >= least:
                    raw = sum(x > r["line"] - r["proj"] for x in res) / len(res)
                    w = len(res) / (len(res) + shrink)
                    pr = p = clip(w * raw + (1 - w) * base)
                    method = "residual_cdf"
                    if len(before) >= blend_least and pm is not None:
                        rb, mb = (sum((s[i] - s[2]) ** 2 for s in before) / len(before) for i in (0, 1))
                        side = min(0.95, max(0.15, 0.5 + 6 * (rb - mb) / max(mb, 1e-6)))
                        p, method = clip((1 - side) * pr + side * pm), "market_residual_blend"
                else:
                    pr, p, method = None, clip(base) if pm is None else pm, "base_rate_fallback" if pm is None else "market_implied_fallback"
                out[r["n"]] = (method, p, len(res))
                r["_s"] = (pr, pm, int(r["v"] > r["line"]))
            scored.setdefault(market, []).extend(r["_s"] for r in mine if (r["season"], r["week"]) == week)
    return out


@pytest.mark.parametrize(("least", "blend_least"), [(5, 12), (20, 1), (1000, 10)])
def test_overs_equal_a_walk_through_the_weeks(spark, least, blend_least):
    rng = random.Random(least)
    rows = []
    for n in range(300):
        proj = rng.randint(5, 25)
        rows.append({"n": n, "season": rng.choice([2022, 2023]), "week": rng.randint(1, 6), "market": rng.choice("ab"), "player": rng.randrange(6), "line": rng.randint(5, 25), "proj": proj, "v": proj + rng.randint(-8, 8), "ip": rng.choice([None, round(rng.uniform(0, 1), 2)]), "seen": n})
    frame = spark.createDataFrame(
        [(r["n"], r["season"], r["week"], r["market"], r["player"], float(r["line"]), float(r["proj"]), float(r["v"]), r["ip"], r["seen"]) for r in rows],
        "n int, season int, week int, market string, player int, line double, model_projection double, actual_value double, implied_probability double, seen int",
    )
    got = {r.n: r for r in overs.over_probabilities(props.probability_input(frame), ["season", "week", "market", "player"], "seen", least, 50.0, blend_least=blend_least).collect()}
    want = plain(rows, least, 50.0, blend_least)
    assert got.keys() == want.keys() and len({m for m, *_ in want.values()}) >= 2
    for n, (method, p, size) in want.items():
        assert (got[n].method, got[n].calibration_sample_size) == (method, size) and got[n].prob_over_model == pytest.approx(p, abs=1e-9), n
        assert got[n].probability_pick_correct == ((p >= 0.5) == (rows[n]["v"] > rows[n]["line"]))


def test_no_rows_no_chances(spark):
    frame = spark.createDataFrame([], "season int, week int, market string, player int, line double, model_projection double, actual_value double, implied_probability double, seen int")
    assert overs.over_probabilities(props.probability_input(frame), ["player"], "seen").collect() == []


def test_nearest_places_over_the_date_line_and_the_pole(spark):
    rng = random.Random(2)
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(900, 89.9, 10.0), (901, 0.0, 179.95), (902, None, 3.0), (903, 10.0, None)]
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(900, 89.8, -170.0), (901, 0.0, -179.95), (902, 0.0, -179.95), (903, None, None)]

    def km(a, b):
        p, q, r, s = map(math.radians, (*a, *b))
        return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))

    left, right = (spark.createDataFrame(x, f"{n} int, lat double, lon double") for x, n in ((spots, "a"), (places, "b")))
    got = sorted((r.a, r["rank"], r.b) for r in joins.nearest_places(left, right, "a", "b", 2, 900.0).collect())
    want = []
    for i, *at in spots:
        near = sorted((km(at, to), j) for j, *to in places if None not in at and None not in to)
        want += [(i, k + 1, j) for k, (d, j) in enumerate(x for x in near if x[0] <= 900)][:2]
    assert got == sorted(want) and (901, 1, 901) in got and (901, 2, 902) in got and any(a == 900 for a, *_ in got)
