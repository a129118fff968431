"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of the id pairs whose tokens end together.

Ids of the second tokenizer are dealt into stripes. Counts of a stripe are a dense matrix, one row for each of its ids and one
column for each id of the first tokenizer, to which the pairs are added; the greatest count of a row is that id's best. Pairs
go there condensed, each with its number in a block of documents, are counted, and scored in the same stripe; what comes
back goes to the block, where each document sums its links. Stripes are salted by block, so that no id is one task's burden.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, one_thread

#: Bytes of text at which a block of documents ends; a longer text is a block of its own. Results don't depend on it.
BLOCK_BYTES = 8 << 20
#: Characters of text that go to the libraries at once.
PORTION = 1 << 20
#: Ids of the second tokenizer in one matrix: with 50,257 columns 51 MB.
STRIPE_IDS = 128
#: Cells of a matrix in one row of its table.
CELLS = 1 << 18


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: visible ones for themselves, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        one_thread()
        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = _byte_letters()
        names = self.first.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        p = self.second
        plain = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(plain)]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        #: What an id reads as inside a group and at its end: A's ids, then B's.
        self.a, self.b = len(self.bytes_a), len(self.bytes_b)
        ends = ((self.a, ","), (self.a, "|"), (self.b, ","), (self.b, ";"))
        self.written = [f"{i}{end}".encode() for n, end in ends for i in range(n)]

        self.flat_a, self.at_a = _flat(self.bytes_a)
        self.flat_b, self.at_b = _flat(self.bytes_b)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each whole text; none where its bytes don't come back."""
        found_a = [_ids(e.ids) for e in self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        found_b = [_ids(x) for x in self.second.encode(texts, num_threads=1)]
        raw = [b" " + t.encode() for t in texts]
        joined = np.frombuffer(b"".join(raw), np.uint8)
        whole = np.array([len(t) > 0 for t in texts])
        for found, flat, at, length in ((found_a, self.flat_a, self.at_a, self.length_a), (found_b, self.flat_b, self.at_b, self.length_b)):
            whole &= _same(found, raw, joined, flat, at, length)
        none = np.zeros(0, np.int32)
        return [a if w else none for a, w in zip(found_a, whole, strict=True)], [b if w else none for b, w in zip(found_b, whole, strict=True)]


def _ids(found: list[int]) -> np.ndarray:
    return np.frombuffer(array("i", found), np.int32)


def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each begins."""
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *[len(t) for t in tokens[:-1]]]).astype(np.int64)


def _same(found: list[np.ndarray], raw: list[bytes], joined: np.ndarray, flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each text whether the bytes of its ids are its own."""
    ids = np.concatenate(found)
    sizes = length[ids]
    ends = np.cumsum(sizes)
    back = flat[np.repeat(at[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
    if len(back) == len(joined) and np.array_equal(back, joined):
        per = np.concatenate([[0], ends])[np.cumsum([len(f) for f in found])]
        if np.array_equal(per, np.cumsum([len(r) for r in raw])):
            return np.ones(len(found), bool)
    cuts = np.concatenate([[0], ends])[np.cumsum([0, *[len(f) for f in found]])]
    return np.array([back[x:y].tobytes() == r for x, y, r in zip(cuts[:-1], cuts[1:], raw, strict=True)])


@lru_cache(maxsize=1)
def _pair(byte_level: str, pieces: str) -> Pair:
    """One for each Python worker."""
    return Pair(byte_level, pieces)


def align(pair: Pair, found_a: list[np.ndarray], found_b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of texts' ids: A ids and B ids of the tokens that end together, how many of them each text has, and the checksums of the groups between."""
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    ends_a, ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
    size = int(ends_a[-1]) + 1 if len(ends_a) else 1
    marked = np.zeros(size, np.int8)
    marked[ends_a] = 1
    marked[ends_b] += 2
    last_a, last_b = np.flatnonzero(marked[ends_a] == 3), np.flatnonzero(marked[ends_b] == 3)
    sizes_a, sizes_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    code_a, code_b = a.copy(), b + np.int32(2 * pair.a)
    code_a[last_a] += pair.a
    code_b[last_b] += pair.b
    codes = np.empty(len(a) + len(b), np.int32)
    codes[np.arange(len(a)) + np.repeat(last_b + 1 - sizes_b, sizes_a)] = code_a
    codes[np.arange(len(b)) + np.repeat(last_a + 1, sizes_b)] = code_b
    written, listed = pair.written.__getitem__, codes.tolist()
    stops_a = np.cumsum([len(x) for x in found_a])
    stops = (stops_a + np.cumsum([len(x) for x in found_b])).tolist()
    checksums, start = [], 0
    for stop in stops:
        checksums.append(hashlib.sha256(b"".join(map(written, listed[start:stop]))[:-1]).hexdigest() if stop > start else "")
        start = stop
    links = np.diff(np.searchsorted(last_a, stops_a), prepend=0)
    return a[last_a], b[last_b], links, checksums


_BLOCKS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, "
    "stripe int, first long, cells binary, counts binary"
)


def blocks(docs: DataFrame, byte_level: str, pieces: str, stripe_ids: int = STRIPE_IDS) -> DataFrame:
    """Two kinds of rows. Documents: their numbers and checksum, and ``links``, each as its pair's number in the block.
    Stripes of the block (``stripe`` not null): ``cells`` (row and column of its distinct pairs in the stripe's matrix), how often the block
    holds them, and the number of the ``first`` of them."""
    schema = [f.split() for f in _BLOCKS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}

    def batch_of(rows: dict[str, list]) -> pa.RecordBatch:
        n = len(next(iter(rows.values())))
        return pa.record_batch([pa.array(rows.get(c, [None] * n), kinds[k]) for c, k in schema], [c for c, _ in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(byte_level, pieces)
        stripes = -(-pair.b // stripe_ids)
        number = TaskContext.get().partitionId() << 20

        def close(ids: list, found: dict[str, list]) -> Iterator[pa.RecordBatch]:
            linked, of_a, of_b = found["links"], np.concatenate(found["of_a"]), np.concatenate(found["of_b"]).astype(np.int64)
            code = ((of_b % stripes) * stripe_ids + of_b // stripes) * pair.a + of_a
            seen, met = pd.factorize(code)
            order = np.argsort(met)
            distinct, times = met[order], np.bincount(seen, minlength=len(met))[order]
            place = np.empty(len(order), "<u2" if len(order) <= 1 << 16 else "<u4")
            place[order] = np.arange(len(order))
            packed = place[seen]
            starts = np.cumsum([0, *linked]).tolist()
            yield batch_of(
                {"block": [number] * len(ids), "doc_id": ids, "n_a": found["n_a"], "n_b": found["n_b"],
                 "n_groups": linked, "groups_sha256": found["checksums"],
                 "links": [packed[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:], strict=True)]}
            )
            stripe, cell = np.divmod(distinct, stripe_ids * pair.a)
            opens = np.flatnonzero(np.diff(stripe, prepend=-1))
            cuts = list(zip(opens.tolist(), [*opens[1:].tolist(), len(stripe)], strict=True)) if len(opens) else []
            yield batch_of(
                {"block": [number] * len(cuts), "stripe": stripe[opens].tolist(), "first": opens.tolist(),
                 "cells": [cell[x:y].astype("<u4").tobytes() for x, y in cuts], "counts": [times[x:y].astype("<i8").tobytes() for x, y in cuts]}
            )

        ids, found, held = [], {}, 0
        for batch in batches:
            every, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in _portions([len(t) for t in texts]):
                found_a, found_b = pair.encode(texts[lo:hi])
                of_a, of_b, links, checksums = align(pair, found_a, found_b)
                told = {"of_a": [of_a], "of_b": [of_b], "links": links.tolist(), "n_a": map(len, found_a), "n_b": map(len, found_b), "checksums": checksums}
                for name, values in told.items():
                    found.setdefault(name, []).extend(values)
                ids += every[lo:hi]
                held += sum(map(len, texts[lo:hi]))
                if held >= BLOCK_BYTES:
                    yield from close(ids, found)
                    ids, found, held, number = [], {}, 0, number + 1
        if ids:
            yield from close(ids, found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _BLOCKS)


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have PORTION characters together; a longer text is one of its own."""
    lo = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > PORTION:
            yield lo, i
            lo, held = i, 0
        held += size
    if sizes:
        yield lo, len(sizes)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for i in range(batch.num_rows):
            yield {c: v[i].as_py() for c, v in columns.items()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [c for c, _ in fields])


def tally(parts: DataFrame, keys: list[str], columns: int, stripe_ids: int) -> DataFrame:
    """(stripe, ``keys``…, cells, counts) to (stripe, cells, counts), summed over all rows of the same ``keys``; one matrix is held at a time."""
    schema = "stripe int, cells binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = np.zeros(stripe_ids * columns, np.int64), None

        def close() -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(matrix)
            for lo in range(0, len(used), CELLS):
                cells = used[lo : lo + CELLS]
                yield _batch([(now[0], cells.astype("<u4").tobytes(), matrix[cells].astype("<i8").tobytes())], schema)
            matrix[used] = 0

        for r in _rows(batches):
            if (key := tuple(r[k] for k in keys)) != now:
                if now is not None:
                    yield from close()
                now = key
            np.add.at(matrix, np.frombuffer(r["cells"], "<u4"), np.frombuffer(r["counts"], "<i8"))
        if now is not None:
            yield from close()

    return parts.select(*keys, "cells", "counts").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def score_pairs(parts: DataFrame, totals: DataFrame, salts: int, columns: int, stripe_ids: int) -> DataFrame:
    """(block, first, counts, best): for the pairs of each stripe of each block their counts over all documents, and whether these are their B id's highest.

    The totals of a stripe lie before its parts in the same task, once for each salt.
    """
    schema = "block long, first long, counts binary, best binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now, best = np.zeros(stripe_ids * columns, np.int64), None, None
        out: list[tuple] = []
        for r in _rows(batches):
            if (key := (r["stripe"], r["salt"])) != now:
                matrix[:], now, best = 0, key, None
            cells = np.frombuffer(r["cells"], "<u4")
            if r["block"] is None:
                np.add.at(matrix, cells, np.frombuffer(r["counts"], "<i8"))
                continue
            if best is None:
                best = matrix.reshape(stripe_ids, columns).max(axis=1)
            counts = matrix[cells]
            out.append((r["block"], r["first"], counts.astype("<i8").tobytes(), (counts == best[cells // columns]).tobytes()))
            if len(out) >= 256:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    every = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumns({c: F.lit(None).cast("long") for c in ("block", "first")})
    names = ["stripe", "salt", "block", "first", "cells", "counts"]
    both = every.select(*names).unionByName(parts.select(*names))
    return both.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("block").asc_nulls_first()).mapInArrow(run, schema)


def sum_links(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum``; a block's scored pairs lie before its documents in the same task."""
    kept = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, best, parts = None, None, None, []
        for batch in batches:
            sums, mine = [], []
            for i, r in enumerate(_rows([batch.select(["block", "first", "counts", "best", "n_groups", "links"])])):
                if r["block"] != now:
                    now, counts, best, parts = r["block"], None, None, []
                if r["first"] is not None:
                    parts.append((r["counts"], r["best"]))
                    continue
                if counts is None:
                    counts = np.frombuffer(b"".join(c for c, _ in parts), "<i8")
                    best, parts = np.frombuffer(b"".join(x for _, x in parts), bool), []
                own = np.frombuffer(r["links"], f"<u{len(r['links']) // r['n_groups']}") if r["n_groups"] else np.zeros(0, np.int64)
                mine.append(i)
                sums.append((int(best[own].sum()), int(counts[own].sum())))
            part = batch.select(kept).take(pa.array(mine, pa.int64()))
            yield pa.record_batch(
                [*part.columns, pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())], [*kept, "n_best", "count_sum"]
            )

    none = lambda kind, *names: {c: F.lit(None).cast(kind) for c in names}
    answers = scored.withColumns(none("long", "doc_id", "n_a", "n_b", "n_groups") | none("string", "groups_sha256") | none("binary", "links"))
    rows = documents.select("block", *kept, "links").withColumns(none("long", "first") | none("binary", "counts", "best"))
    return (
        answers.unionByName(rows).repartition("block").sortWithinPartitions("block", F.col("first").asc_nulls_last()).mapInArrow(run, schema)
    )


def align_tokenizers(
    docs: DataFrame, byte_level: str, pieces: str, stripe_ids: int = STRIPE_IDS, salts: int = 4,
    scratch: Callable[..., Scratch] = Scratch,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``byte_level`` is a byte-level BPE file, which encodes a space and the text; ``pieces`` a model with byte fallback that adds
    the space itself. Null and empty texts, and those whose bytes don't come back from both, have zeros and an empty checksum, and no part in the counts. Null
    ids and repeated rows keep their rows, and repeats count; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = scratch(spark, "alignment")
    pair = _pair(byte_level, pieces)
    stored = shared.write(blocks(docs, byte_level, pieces, stripe_ids), "blocks", compression="zstd")
    parts = stored.filter(F.col("stripe").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    salted = tally(parts, ["stripe", "salt"], pair.a, stripe_ids)
    totals = shared.write(tally(salted, ["stripe"], pair.a, stripe_ids), "totals")
    scored = score_pairs(parts, totals, salts, pair.a, stripe_ids)
    found = sum_links(stored.filter(F.col("stripe").isNull()), scored)
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
