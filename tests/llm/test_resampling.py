import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridspark.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, width, buckets):
    words = WORDS.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, width, buckets, percent, least):
    own = [(i, *grams(t, width, buckets)) for i, t in docs]
    s = Counter(b for *_, f in own for b in f)
    t = Counter(b for x in target for b in grams(x, width, buckets)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = [(*r, k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)]
    return sorted(ranks + [(*r, None) for r in rows if r[1] < least], key=repr)


DOCS = [
    (1, "The cat sat on the mat. The CAT sat, on the mat!"),
    (2, "the cat sat on the mat the cat sat on the mat"),
    (3, None),
    (4, ""),
    (5, "... \x0b --- \x00"),
    (6, "Ärger über Öl und É cat 12 cat12"),
    (7, "the cat sat on the mat the cat sat on the mat"),
    (7, "the cat sat on the mat the cat sat on the mat"),
    (7, "a sat mat cat on"),
    (None, "the mat the mat the mat the mat"),
    (None, "the mat the mat the mat the mat"),
    (9, " ".join(f"w{i % 700}" for i in range(20_000))),
    (10, "one"),
    (11, "same same same same same same same same"),
]
TARGET = ["cat on the mat", None, "", "über öl, the CAT 12", "same same"]


@pytest.mark.parametrize(("width", "buckets"), [(1, 10_000), (3, 97), (2, 70_000)])
@pytest.mark.parametrize("parts", [1, 5])
def test_equals_brute_force(spark, width, buckets, parts):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in DOCS], "doc_id long, text string, id string, rank int, packed int").repartition(parts)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = resampling.resample(docs, target, width=width, buckets=buckets, percent=50, least_words=5).collect()
    assert sorted(map(tuple, got), key=repr) == brute(DOCS, TARGET, width, buckets, 50, 5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(none, target).collect() == []
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    got = resampling.resample(docs, target, percent=50, least_words=5).collect()
    assert sorted(map(tuple, got), key=repr) == brute(DOCS, [], 1, 10_000, 50, 5)


def test_ranks_are_dense_whole_and_the_same_again(spark):
    docs = spark.createDataFrame([(i % 900, "word " * 20 + f"w{i % 7}") for i in range(1000)], "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([(0, "w3 w3")], "item_id long, text string")
    runs = [resampling.resample(docs.repartition(n), target).collect() for n in (3, 11)]
    assert sorted(r["rank"] for r in runs[0] if r["rank"]) == list(range(1, 101))
    assert sorted(map(tuple, runs[0]), key=repr) == sorted(map(tuple, runs[1]), key=repr)


def test_suffixes_and_prefixes_against_plain_sorting():
    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 5):
        ids = rng.integers(0, 4, 400)
        order = resampling.suffix_order(ids, width)
        padded = [*ids.tolist(), *[0] * width]
        windows = [tuple(padded[i : i + width]) for i in order]
        assert windows == sorted(windows) and sorted(order) == list(range(400))
        shared = resampling.common_prefixes(ids, order, width)
        for a, b, n in zip(windows, windows[1:], shared[1:], strict=False):
            want = 0
            while want < width and a[want] == b[want] != 0:
                want += 1
            assert n == want
