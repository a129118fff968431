import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import packing

SCHEMA = "doc_id long, text string, length string, piece long"


def padding(hist, ends):
    return sum(n * (min(e for e in ends if e >= l) - l) for l, n in hist.items())


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        hist = {rng.randint(0, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        lengths = np.array(sorted(hist))
        for k in (1, 2, 3, 5):
            ends = packing.optimal_boundaries(lengths, np.array([hist[int(l)] for l in lengths]), k)
            assert len(ends) <= k and ends == sorted(ends) and ends[-1] == lengths[-1]
            best = min(
                padding(hist, c + (int(lengths[-1]),))
                for r in range(k)
                for c in itertools.combinations([int(l) for l in lengths[:-1]], r)
            )
            assert padding(hist, ends) == best


def test_every_word_is_packed_once(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice((0, 1, 5, 30, 99, 100, 101, 777)), "x", 1) for i in range(300)]
    rows += [(None, "a b", None, None), (None, None, None, None), (5, rows[5][1], "x", 1)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), buckets=4, max_len=100, budget=1000).collect()
    total = defaultdict(int)
    for r in rows:
        total[r[0]] += len((r[1] or "").split())
    got, batches = defaultdict(int), defaultdict(list)
    for r in out:
        got[r.doc_id] += r.length
        assert 0 <= r.length <= r.bucket_len <= 100 and r.start == 100 * r.piece
        batches[r.bucket_len, r.batch].append(r.slot)
    assert got == total and len({b for b, _ in batches}) <= 4
    short = defaultdict(int)
    for (end, _), slots in batches.items():
        full = 1000 // max(end, 1)
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= full
        short[end] += len(slots) < full
    assert max(short.values()) <= 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_edges(spark, rows):
    out = packing.pack(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == len(rows)


def test_budget_below_piece_is_refused(spark):
    with pytest.raises(ValueError, match="max_len"):
        packing.pack(spark.createDataFrame([], SCHEMA), max_len=10, budget=5)


def test_lengths_of_tokens_and_copies(spark):
    """Any column may hold the lengths; copies of one document are told apart by their row."""
    docs = spark.createDataFrame([(1, "a b", [5] * 7), (1, "a b", [5] * 7), (2, "c", [])], "doc_id long, text string, ids array<int>")
    out = packing.pack(docs, 2, 4, 8, F.size("ids")).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in out) == [(1, 0, 4), (1, 0, 4), (1, 1, 3), (1, 1, 3), (2, 0, 0)]
    assert len({(r.row, r.piece) for r in out}) == 5
