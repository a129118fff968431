import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridspark.llm import token_orc as T

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, shard string, ids int"


def brute(rows):
    tokenizer, out, start = Tokenizer.from_file(VOCABULARY), [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def texts():
    rng = random.Random(4)
    bits = ["word", " of", "  ", "\n", "\n\n ", "'s", "don't", "É", "ß", "12", "1a", "!?", "\t", "<|endoftext|>", "日本", " ", "\x1c", "😀", "…", "²", "ª"]
    out = [None, "", " ", "<|endoftext|>", "x" * 50_000]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    """Texts of odd white space, format characters and added tokens, by two tokenizers of different make."""
    encoder, rng = T.Encoder(public_tokenizers.path(name)), random.Random(1)
    assert encoder.cuts == (name == "byte_bpe_50k.json")
    bits = [*"ab'sé 1,.  \n\t ᠎​\x1c\x85Ġ日", "<|endoftext|>", "'ll", " x", " y", " word"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for lo in range(0, len(odd), 97):
        part = odd[lo : lo + 97]
        want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert encoder.encode(part) == want


def test_worker_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    encoder, plain = T.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in (t for t in texts() if t):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, tmp_path):
    rows = [(3 * i + 1, t) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
    got = T.encode_to_orc(docs, str(tmp_path / "t"), VOCABULARY).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(rows)
    one = T.read(spark, str(tmp_path / "t"), [rows[0][0]]).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    assert one[0].ids == [*tokenizer.encode(rows[0][1] or "", add_special_tokens=False).ids, 0]
    plan = T.read(spark, str(tmp_path / "t"), [5])._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(doc_id,5)]" in plan or "PushedFilters: [In(doc_id, [5])]" in plan or "PushedFilters: [IsNotNull(doc_id)" in plan


def test_starts_are_places_in_the_files(spark, tmp_path):
    """Texts that share an id stand in the digest as they lie in the shards."""
    docs = spark.createDataFrame([(i % 7, f"word{i} " * (i % 5), None, None) for i in range(200)] + [(None, "x y", None, None)] * 3, SCHEMA).repartition(4)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in T.encode_to_orc(docs, str(tmp_path / "t"), VOCABULARY).collect())
    start, want = 0, []
    for r in T.read(spark, str(tmp_path / "t")).orderBy("shard", "place").collect():
        want.append((start, r.doc_id, len(r.ids)))
        start += len(r.ids)
    assert got == want and [d for _, d, _ in want] == sorted((d for _, d, _ in want), key=lambda d: -1 if d is None else d)


def test_whole_tables(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = T.encode_to_orc(docs, str(tmp_path / "t"), VOCABULARY).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, None), (2, "a b"), (2, "a b")]])
def test_edges(spark, tmp_path, rows):
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = T.encode_to_orc(docs, str(tmp_path / "t"), VOCABULARY).collect()
    assert sorted((r.start, r.n_tokens) for r in got) == ([(0, 1), (1, 3), (4, 3)] if rows else [])


def test_chunks_are_looked_up_once_a_batch():
    class Counted(dict):
        looked = 0

        def get(self, key):
            Counted.looked += 1
            return super().get(key)

        def __getitem__(self, key):
            Counted.looked += 1
            return super().__getitem__(key)

    encoder, plain = T.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    encoder.known, batch = Counted(), ["a" + " word, other" * 500, "b other", "c \x1c d other"]
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(batch)] == [plain.encode(t, add_special_tokens=False).ids for t in batch]
    assert Counted.looked == 2 * len({"word,", "other", "\x1c", "d"})


def test_words_go_to_the_library_once_whatever_marks_they_have():
    encoder, plain, sent = T.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY), []
    library = encoder._library
    encoder._library = lambda texts: sent.extend(texts) or library(texts)
    batch = ["a" + "".join(f" überlichstation{a}" for a in ("", ".", ",", "!", "?", ".\nOf", ",\nOf", "-of", ")", '"', ".)", "'s")) for _ in range(3)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(batch)] == [plain.encode(t, add_special_tokens=False).ids for t in batch]
    # alone, and with the apostrophe, where no cut is sure
    assert sum(t.count("überlichstation") for t in sent) == 2


def test_cuts_are_places_where_the_pattern_cuts():
    cutter, rng, seen = Tokenizer.from_file(VOCABULARY).pre_tokenizer, random.Random(7), 0
    bits = [*"aZé×÷ßŁɏжѿ09²½.,-'’“—_\n\t\r\x0b\x1c\x7f\x85", " ", " ", "  ", " ", " ", "　", "​", "日", "😀", "'s", "'ll", "é", "᠎", " "]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        sure = set(np.flatnonzero(T._cuts(np.frombuffer(text.encode(), np.uint8))).tolist())
        begin = {len(text[:a].encode()) for _, (a, _) in cutter.pre_tokenize_str(text)}
        assert sure <= begin
        seen += len(sure)
    assert seen > 10_000
