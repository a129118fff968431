import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from gridspark.llm import alignment
from gridspark.llm.common import table

FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(docs):
    """Token by token, from the two libraries and their vocabularies."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    first = Tokenizer.from_file(FILES[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    keys = {}
    for b in range(256):  # the letter of each byte, from the library's own pre-tokenizer
        if b < 128:
            keys[first.pre_tokenizer.pre_tokenize_str(bytes([b]).decode())[0][0]] = b
    letters = alignment._byte_letters()
    assert all(letters[k] == v for k, v in keys.items())
    decode = decoders.ByteLevel()

    def of_a(i):
        raw = bytes(letters[c] for c in first.id_to_token(i))
        assert raw.decode("utf-8", "replace") == decode.decode([first.id_to_token(i)])
        return raw

    def of_b(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(of(i)), i))
        return out

    rows, links = [], []
    for doc_id, text in docs:
        raw = b" " + (text or "").encode()
        a = spans(first.encode(" " + (text or ""), add_special_tokens=False).ids, of_a)
        b = spans(second.encode(text or ""), of_b)
        if not text or any(b"".join(of(i) for *_, i in x) != raw for x, of in ((a, of_a), (b, of_b))):
            a, b = [], []
        common = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = []
        for lo, hi in zip([0, *common], common, strict=False):
            groups.append("|".join(",".join(str(i) for s, e, i in x if lo <= s and e <= hi) for x in (a, b)))
        own = [(x, y) for _, e, x in a for _, f, y in b if e == f] if len(a) < 3000 else None
        if own is None:
            ends = {f: y for _, f, y in b}
            own = [(x, ends[e]) for _, e, x in a if e in ends]
        links.append(own)
        rows.append([doc_id, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    counts = Counter(x for own in links for x in own)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for r, own in zip(rows, links, strict=True):
        out.append((*r[:5], sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), r[5]))
    return sorted(out, key=repr)


DOCS = [
    (1, "Hello world, hello world again."),
    (2, None),
    (3, ""),
    (4, "<|endoftext|> and <s> </s> <unk> <0x41> are plain text"),
    (5, "a▁b"),
    (6, " two  spaces\tand\n\nlines  "),
    (7, "ÄÖÜ ß 日本語 \U0001f600 é é   ﬁ"),
    (8, " "),
    (9, "\x00\x01 control"),
    (10, "x" * 3000),
    (1, "Hello world, hello world again."),
    (None, "Hello there"),
    (None, "Hello there"),
    (11, " ".join(f"word{i % 50}" for i in range(4000))),
    (12, "  ﻿ ​"),
]


@pytest.mark.parametrize(("parts", "stripe_ids", "salts"), [(1, 128, 1), (4, 1000, 3), (15, 7, 2)])
def test_equals_brute_force(spark, parts, stripe_ids, salts):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, block int, links string").repartition(parts)
    got = alignment.align_tokenizers(docs, *FILES, stripe_ids=stripe_ids, salts=salts).collect()
    assert sorted(map(tuple, got), key=repr) == brute(DOCS)


def test_whole_small_table_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = alignment.align_tokenizers(docs, *FILES).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_nothing_to_align(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(none, *FILES).collect() == []
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_tokenizers(empty, *FILES).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_groups_of_a_pair_of_ids():
    pair = alignment.Pair(*FILES)
    texts = ["unbelievably tokenised", "", "a▁b", "twice twice"]
    found_a, found_b = pair.encode(texts)
    assert [len(x) > 0 for x in found_a] == [len(x) > 0 for x in found_b] == [True, False, False, True]
    of_a, of_b, links, checksums = alignment.align(pair, found_a, found_b)
    assert links.sum() == len(of_a) == len(of_b) and checksums[1] == checksums[2] == ""
    for a, b, n, checksum in zip(found_a, found_b, links, checksums, strict=True):
        ends_a, ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
        common = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
        assert n == len(common)
        if common:
            of = lambda ids, ends, lo, hi: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi)
            text = ";".join(f"{of(a, ends_a, lo, hi)}|{of(b, ends_b, lo, hi)}" for lo, hi in zip([0, *common], common, strict=False))
            assert hashlib.sha256(text.encode()).hexdigest() == checksum


def test_portions():
    assert list(alignment._portions([])) == [] and list(alignment._portions([0, 0, 3])) == [(0, 3)]
    n = alignment.PORTION
    assert list(alignment._portions([n + 1, 1, n, n - 1, 1, 5])) == [(0, 1), (1, 2), (2, 3), (3, 5), (5, 6)]
