import random
import re
from collections import Counter

import numpy as np
import pytest

from gridspark.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, l in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", l) and l in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "a b c a b c", "x\n\nx\n \n ", "é ö ü\u0085z"]
    texts += ["".join(rng.choice(["ab ", "c ", "é ", "#* ", "\n", " ", "d\r"]) for _ in range(rng.randint(1, 400))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, None, "s", "clash") for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.judge(docs, labels).collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept != r.base_failed


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen, held = labels.filter("doc_id % 3 != 0"), labels.filter("doc_id % 3 = 0")
    rows = quality.judge(docs, seen).join(held, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    poor = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(poor) <= 0.1


def test_constraints_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=1500) > 0).astype(float)
    trees = quality.grow(x, y, [1, -1, 0])
    base = rng.normal(size=(50, 3))
    for f, sign in ((0, 1), (1, -1)):
        moved = [trees.score(np.where(np.arange(3) == f, v, base)) for v in np.linspace(-3, 3, 60)]
        assert np.all(sign * np.diff(moved, axis=0) >= -1e-12)
    assert np.mean((trees.score(x) > 0.5) == y) > 0.7


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "word " * 60, None, None, None)] * 2])
def test_edges(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == len(rows)


def test_very_long_text():
    counts, _ = quality.statistics(("word%d " * 3 % (1, 2, 3) * 300_000).encode())
    assert counts[0] == counts[4] == 900_000
