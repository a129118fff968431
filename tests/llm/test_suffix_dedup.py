import hashlib
import random

import numpy as np
import pytest

from gridspark.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, b string, spans string"


def brute(rows, least):
    """From the definition: each window's first start, over documents in order."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            if w in seen:
                gone[p : p + least] = True
            seen.add(w)
        gone = gone[: len(b)]
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def corpus(rng, n):
    words = ["alpha", "be", "gämma", "delta", "e", "\n", "zeta zeta"]
    prose = lambda k: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(k))
    shared = [prose(rng.randint(8, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared)[rng.randrange(20) :] if rng.random() < 0.5 else prose(rng.randint(1, 30)) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 500), (n + 3, "ab" * 300), (n + 4, rows[3][1])]


@pytest.mark.parametrize(("least", "group"), [(100, 20_000), (30, 20_000), (60, 1), (100, 1), (101, 4), (8, 2)])
def test_matches_brute_force(spark, monkeypatch, least, group):
    monkeypatch.setattr(S, "GROUP_RUNS", group)
    rows = corpus(random.Random(least), 120)
    docs = spark.createDataFrame([(i, t, "clash", None) for i, t in rows], SCHEMA).repartition(4)
    assert result(S.deduplicate(docs, least)) == brute(rows, least)


@pytest.mark.parametrize("group", [1, 3, 25])
def test_a_common_passage_in_many_contexts(spark, monkeypatch, group):
    """One core stands in a hundred different runs, some of them equal in part: it is widened until its parts fit, with the same result."""
    monkeypatch.setattr(S, "GROUP_RUNS", group)
    rng = random.Random(4)
    middle = "".join(rng.choice("abcdefgh ") for _ in range(85))
    edge = lambda: rng.choice(["left one ", "the other ", ""]) + "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 40)))
    rows = [(i, edge() + middle + edge()) for i in range(120)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA).repartition(3)
    got = result(S.deduplicate(docs))
    assert got == brute(rows, 100) and sum(g[1] > 0 for g in got.values()) > 5


def test_long_texts_in_pieces(spark, monkeypatch):
    """Texts longer than a hashed piece: repeats across its borders are found."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    rows = [(1, text), (2, "x" + text[1_040_000:1_060_000] + "y"), (3, text[:500])]
    got = result(S.deduplicate(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)))
    assert [got[i][1:3] for i in (1, 2, 3)] == [(0, 0), (20_000, 1), (500, 1)]


def test_suffix_order_and_prefixes():
    rng = random.Random(2)
    for _ in range(100):
        text = np.array([rng.choice((1, 1, 2, 3)) for _ in range(rng.randint(1, 60))] + [0], np.int16)
        order = S.suffix_order(text, 64)
        suffixes = [tuple(text[i:]) for i in order]
        assert suffixes == sorted(suffixes)
        least = rng.randint(1, 6)
        got = S.long_prefixes(text[order - 1], least)
        for k in range(1, len(order)):
            a, b = suffixes[k - 1], suffixes[k]
            if 0 not in a[:least] and 0 not in b[:least]:
                assert got[k] == (a[:least] == b[:least])


def test_edges(spark):
    long = "word " * 30
    rows = [(None, long), (1, long), (1, long), (2, None), (3, "z" * 99)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_removed) for r in S.deduplicate(docs).collect())
    # period 5: from its fifth byte on the first text repeats itself; the later ones are gone
    assert got == [("1", 150), ("1", 150), ("2", 0), ("3", 0), ("None", 145)]
    assert S.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
