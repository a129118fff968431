import itertools

import numpy as np
import pytest

from gridspark.llm import curve_search as C

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cid int"


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_hilbert_walks_through_every_cell(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = C.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert np.all(np.abs(np.diff(path, axis=0)).sum(axis=1) == 1)


def brute(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            near = sorted((-float(q @ v), j) for j, v in zip(ids, x, strict=True) if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def frame(spark, ids, x):
    rows = [(int(i), [float(c) for c in v], 0, "clash", 1) for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("kind", ["sphere", "lengths"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.uniform(0.5, 2, size=(4000, 1)).astype(np.float32)
    ids = rng.permutation(4000)
    got, want = found(C.search(frame(spark, ids, x))), brute(ids, x.astype(float), 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    exact = {int(i): v.astype(float) for i, v in zip(ids, x, strict=True)}
    assert all(s == pytest.approx(float(exact[q] @ exact[j]), abs=1e-12) for q in got for j, s in got[q])


def test_recall_on_the_given_embeddings(spark):
    """The whole table against brute force in numpy; a query's vectors have next to no structure, see the README."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    rows = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    got, want = found(C.search(vectors)), brute(ids, x, 20, 20)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    print(len(want), "queries over", len(ids), "vectors, recall at 20:", hits / (20 * len(want)))
    assert got.keys() == want.keys() and hits >= 0.95 * 20 * len(want)


def test_copies_and_ties(spark):
    """A third of the rows hold one vector: its smallest ids win, and its queries skip themselves."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[::3] = x[0]
    ids = np.arange(300)
    got, want = found(C.search(frame(spark, ids, x), curves=8, aim=1.0)), brute(ids, x.astype(float), 20, 20)
    assert [j for j, _ in got[60]] == [j for j, _ in want[60]]
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (20, [2.0, 0.0]), (40, [1.0, 2.0, 3.0]), (60, [])]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)
    got = found(C.search(df))
    assert got == {0: [(20, 2.0), (1, 1.0)], 20: [(0, 2.0), (1, 2.0)]}
    assert C.search(spark.createDataFrame([], SCHEMA)).count() == 0
