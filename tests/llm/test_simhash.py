import random

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridspark.llm import simhash
from gridspark.llm.common import Scratch


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    head = {i: i for i in ids}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                head[b] = a
    return {i: root(i) for i in ids}


def test_documents_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Été", "a b"]
    texts = {}
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(1, 300))]
        texts[i] = " ".join(base)
        if i % 3 == 0 and i:
            base = texts[i - 1].split(" ")
            base[rng.randrange(len(base))] = "changed"
            texts[i] = "\n".join(base)
    texts |= {200: None, 201: "", 202: " \t", 203: "One two", 204: "one  TWO"}
    rows = [(k, v, "extra") for k, v in texts.items()]
    got = {
        r.doc_id: r
        for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    }
    prints = {k: brute_print(v) for k, v in texts.items()}
    assert {k: r.fp & (2**64 - 1) for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("direct", [0, 4096])
def test_every_pair_within_four_bits_is_linked(spark, monkeypatch, direct):
    """Chains of near fingerprints, joined or in blocks, give the components of brute force."""
    monkeypatch.setattr(simhash, "DIRECT_PAIRS", direct)
    monkeypatch.setattr(simhash, "HOME_BLOCK", 16)
    monkeypatch.setattr(simhash, "VISIT_BLOCK", 16)
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.add(fp)
            for b in rng.sample(range(64), rng.choice((3, 4, 4, 5, 6))):
                fp ^= 1 << b
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    scratch = Scratch(spark, "test")
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.connected_components(simhash.links(frame, scratch), scratch).collect()
    got = {p: p for p in signed} | {r.node: r.label for r in found}
    want = brute_components({p: p & (2**64 - 1) for p in signed})
    assert got == want


def test_anchors_lie_within_radius_plus_threshold(spark):
    frame = spark.createDataFrame([(random.Random(i).getrandbits(63),) for i in range(50)], "fp long")
    for r in simhash.anchors(frame).collect():
        first, bits = simhash.PARTS[r.part]
        away = ((r.fp >> first & ((1 << bits) - 1)) ^ r.anchor).bit_count()
        assert away <= (1 if r.home else 2)


def test_edges_of_input(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "same text here now", "en", None, 1), (1, "same text here now", "en", None, 1), (None, "same text here now", None, None, None), (5, "x " * 50_000, None, "s", 2)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [("1", 1), ("1", 1), ("5", 5), ("None", 1)]
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [1, 5]
    assert simhash.deduplicate(docs).columns == docs.columns
