import zlib

import numpy as np
import pytest

from gridspark.llm import toxicity
from gridspark.llm.common import table

LARGE = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_labels_that_were_not_learnt(spark):
    docs, labels = table(spark, LARGE, "documents"), table(spark, LARGE, "labels")
    rows = toxicity.judge(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    score, y = np.array([r.score for r in held]), np.array([r.toxic for r in held])
    said = np.array([r.predicted for r in held])
    assert len(held) > 700 and auc(score, y) > 0.98
    assert (said == y).mean() > 0.98 and (said[y == 0] == 0).mean() > 0.995 and (said[y == 1] == 1).mean() > 0.85
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(encode(string(doc_id), 'utf-8')) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted(map(tuple, toxicity.judge(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_pairs_say_what_single_terms_cannot():
    """Which word stands with which group decides, and none of them alone says anything; harmless words stand beside them."""
    rng = np.random.default_rng(11)
    y, rows = np.zeros(3000), []
    for i in range(3000):
        word, group = (int(x) for x in rng.integers(0, 2, 2))
        rows.append(np.array([word, 2 + group, *np.unique(4 + rng.integers(0, 40, 6))]))
        y[i] = word == group
    machines = {rank: toxicity.fit(np.arange(44), rows[:2000], y[:2000], rank=rank, epochs=40) for rank in (0, 8)}
    right = {rank: auc(m.score(rows[2000:]), y[2000:]) for rank, m in machines.items()}
    pairs = machines[8].factors[:2] @ machines[8].factors[2:4].T
    assert right[0] < 0.6 and right[8] > 0.95
    assert min(pairs[0, 0], pairs[1, 1]) > max(pairs[0, 1], pairs[1, 0])


def test_scores_equal_the_plain_sum():
    rng = np.random.default_rng(5)
    m = toxicity.Machine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    rows = [np.array([], int), np.array([2]), np.array([0, 3, 8]), np.arange(9)]
    for row, got in zip(rows, m.score(rows), strict=True):
        raw = m.bias + m.weights[row].sum() + sum(m.factors[i] @ m.factors[j] for i in row for j in row if i < j)
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "x", 1.0), (2, "", "x", 1.0), (None, "you idiot", "x", 1.0), (None, "you idiot", "x", 1.0), (3, "fine " * 200_000, "x", 1.0), (3, "\x00  ", "x", None)],
        "doc_id long, text string, toxic string, score double",
    )
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1), (3, 0), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.judge(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.judge(docs.limit(0), labels).collect() == []
    none = toxicity.judge(docs, labels.limit(0)).collect()
    assert len(none) == 6 and {r.predicted for r in none} == {0}


def test_one_kind_of_label_gives_one_score(spark):
    docs = spark.createDataFrame([(i, f"word{i} idiot") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.judge(docs, labels).collect()}) == 1
