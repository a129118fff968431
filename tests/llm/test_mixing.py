import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import mixing
from gridspark.llm.common import Scratch

SCHEMA = "doc_id long, text string, source string, size string, copies long"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        level = rest / max(1, sum(weight[s] for s in names if s not in full))
        target = {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def documents(spark, seed, sources):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        s = rng.choices(sources, [2**-k for k in range(len(sources))])[0]
        rows.append((i, " ".join(["w"] * min(4000, int(rng.paretovariate(0.9) * 20))), s, "clash", 7))
    return rows


@pytest.mark.parametrize("sources", [["a", "B", None, "é", "z", "😀"], [None]])
def test_words_come_near_targets(spark, sources):
    rows = documents(spark, len(sources), sources)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs).collect()
    want = {r[0]: len(r[1].split()) for r in rows}
    assert {r.doc_id: r["size"] for r in out} == want
    per = defaultdict(int)
    for r in rows:
        per[r[2]] += want[r[0]]
    target = brute_targets(dict(per))
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == per[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in per:
        assert abs(taken[s] - target[s]) <= max(25, 0.002 * target[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def dense(rows, target, cap=3.0, slack=0.1):
    """Rates of (source, size, prior), by Newton's method with step halving on the whole dual at once, document by document."""
    names = sorted(target, key=str)
    size = np.array([r[1] for r in rows], float)
    prior = np.array([r[2] for r in rows], float)
    which = np.array([names.index(r[0]) for r in rows])
    kind = np.searchsorted(mixing.LENGTHS, size, side="right")
    x = np.zeros((len(rows), len(names) + len(mixing.CLASSES)))
    x[np.arange(len(rows)), which] = 1
    x[np.arange(len(rows)), len(names) + kind] = 1
    held = np.bincount(kind, size, len(mixing.CLASSES))
    aim = np.concatenate(([target[n] for n in names], held))
    ridge = np.concatenate((np.zeros(len(names)), slack * held))
    of_source = np.bincount(which, size, len(names))
    full = (np.array([target[n] for n in names]) >= cap * of_source)[which]

    def look(m):
        z = np.log(prior) + x @ m
        rate = np.where(full, cap, np.exp(np.minimum(z, np.log(cap))))
        value = (size * np.where(full, cap * z, rate + cap * np.maximum(0, z - np.log(cap)))).sum() - aim @ m + ridge @ m**2 / 2
        return value, rate, size * rate * (z < np.log(cap)) * ~full

    m = np.zeros(x.shape[1])
    for _ in range(300):
        value, rate, bend = look(m)
        slope = x.T @ (size * rate) - aim + ridge * m
        if np.abs(slope / np.maximum(aim, 1)).max() < 1e-11:
            break
        move = np.linalg.lstsq((x * bend[:, None]).T @ x + np.diag(ridge), slope, rcond=1e-14)[0]
        t = min(1.0, 2 / np.abs(move).max())
        while look(m - t * move)[0] > value + 1e-13 * abs(value) and t > 1e-9:
            t /= 2
        m = m - t * move
    return rate


@pytest.mark.parametrize("seed", [1])
def test_rates_are_those_of_a_dense_solution(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        s = rng.choices(["a", "b", "c", None], [8, 4, 2, 1])[0]
        rows.append((i, " ".join(["w"] * min(6000, int(rng.paretovariate(0.7) * (20 if s == "a" else 60)))), s, None, rng.choice([1, 2, 4])))
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs, prior=F.col("copies") / 2.0).collect()
    known = {r[0]: r for r in rows}
    per = defaultdict(int)
    for r in out:
        per[r.source] += r["size"]
    target = brute_targets(dict(per))
    want = dense([(r.source, r["size"], known[r.doc_id][4] / 2.0) for r in out], target)
    assert max(abs(r.rate - w) for r, w in zip(out, want, strict=True)) < 1e-6
    assert out[0].steps > 2 and out[0].residual < 1e-9
    assert len({round(r.rate, 9) for r in out if r.source == "a"}) > 3  # tilted by length class and prior, not one rate a source


def test_no_balance_is_an_error(spark):
    cells = spark.createDataFrame([("sa", 1.0, 100, 50, 10, 0, 9)], "k string, prior double, w0 long, w1 long, w2 long, w3 long, w4 long")
    targets = spark.createDataFrame([("sa", 230.0)], "k string, t double")
    with pytest.raises(RuntimeError):
        mixing.balance(cells, targets, Scratch(spark, "t"), 3.0, max_steps=2)
    assert mixing.balance(cells, targets, Scratch(spark, "t"), 3.0).steps > 2


def test_materialised_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2], None, i) for i in range(60)] + [(3, "w w w w", "b", None, 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out.collect()) == +copies


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "a", None, 1), (1, "", "a", None, 1)]])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(r.taken == 0 and r.target == 0 for r in out)
    assert mixing.materialise(docs).count() == 0


def test_word_count(spark):
    text = "a\u0085b \t\x1cc é\x0b d"
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(mixing.word_count()).first()[0] == len(re.findall(r"[^\x20\x09-\x0D]+", text))
