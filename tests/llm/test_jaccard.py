import random

import numpy as np
import pytest

from gridspark.llm import jaccard, simhash
from gridspark.llm.common import Scratch, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def groups(texts, threshold=4):
    """Components of brute force over all pairs: four bits or a similarity of 0.8."""
    sets = {k: jaccard.shingles(t.encode()) for k, t in texts.items()}
    prints = {k: simhash.fingerprint(t.encode(), 5) for k, t in texts.items()}
    head = {k: k for k in texts}

    def root(k):
        while head[k] != k:
            k = head[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= threshold or (len(sets[a]) and jaccard.similar(sets[a], sets[b])):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    return {k: root(k) for k in texts}


@pytest.mark.parametrize(("rounds", "block"), [(2, 1024), (0, 5), (1, 30)])
def test_planted_near_copies_are_found_and_others_stay(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rng = random.Random(7)
    texts, n = {}, 0
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        for share in (0, 0.01, 0.02, 0.03, 0.2)[: rng.randint(1, 5)]:  # a word touches five shingles
            texts[n] = " ".join(edited(rng, base, share) if share else base)
            n += 1
    for i in range(25):  # copies of one text that are all edited, and not similar to each other but through it
        texts[n + i] = " ".join(edited(rng, base, 0.02))
    want = groups(texts)
    rows = [(k, t, "en", "s", 1) for k, t in texts.items()] + [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, texts[0].upper(), "en", "s", 1)]
    rng.shuffle(rows)
    kept = {r.doc_id for r in jaccard.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert kept == {k for k, h in want.items() if k == h} | {1000}
    by_bits = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, SCHEMA), width=5).collect()}
    assert len(by_bits) > len(kept) + 20


def test_recall_on_the_documents(spark):
    """Pairs of similarity 0.8 or more, from all pairs that share a shingle, end in one group."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = groups({k: t for k, t in texts.items() if len(t.split()) >= 5})
    kept = {r.doc_id for r in jaccard.deduplicate(docs).collect()}
    heads = {k for k, h in want.items() if k == h}
    print(len(texts), len(heads), len(kept & heads), len(kept - heads))
    assert len((kept & set(want)) ^ heads) <= 0.01 * len(heads)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        rest = int(1000 * (1 - share) / share / 2)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, rest, dtype=np.uint64)])) for _ in range(2))
        same = np.mean(np.frombuffer(jaccard.signature(a), "<u4") == np.frombuffer(jaccard.signature(b), "<u4"))
        assert same == pytest.approx(share, abs=0.13)
    assert jaccard.similar(np.arange(5), np.arange(4)) and not jaccard.similar(np.arange(6), np.arange(4))


def test_pairs_are_compared_with_their_own_leader(spark):
    pairs = spark.createDataFrame([(u, v) for u in range(20) for v in range(100, 140)], "u long, v long").repartition(7)
    values = spark.createDataFrame([(i, bytes([i % 5])) for i in [*range(20), *range(100, 140)]], "fp long, x binary")
    got = {tuple(r) for r in jaccard.compared(pairs, values, "x", lambda a, b: a == b).collect()}
    assert got == {(u, v) for u in range(20) for v in range(100, 140) if u % 5 == v % 5}


def test_edges(spark):
    assert jaccard.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None), (2, "", "x", None, 1), (None, " \t", None, None, None), (3, "one two", "en", "s", 1), (4, "One  TWO", "en", "s", 1), (5, "x " * 100_000, "en", "s", 1)]
    got = sorted((r.doc_id or 0) for r in jaccard.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [1, 3, 5]
