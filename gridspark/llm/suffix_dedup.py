"""Removal of byte passages that occurred before, by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A text's windows of the least length are dealt to groups by their content, so that equal windows always meet: each has an anchor
(the k-gram of least hash) and a core around it. Runs of windows with a core that occurs once can hold no repeat
and go no further. Runs with the same bytes are counted as one. What is left is short and nearly equal; in each group of runs
a Burrows-Wheeler transform is built, and breadth-first backward extension derives the common prefixes by increasing
value up to the least length. Suffixes that share more hold the repeats. A group too large for one transform is dealt anew by wider cores,
which fewer windows share, until its parts fit.

Runs with the same bytes are found by two 64-bit hashes of different make, one of the core and one of the whole; all else is compared by bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, text_bytes

#: Bytes of an anchor: the k-gram of least hash in a window names the group in which the window is compared.
GRAM = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Cores that the windows of one anchor are dealt to: more are stricter, and give shorter runs.
CORES = 2
#: Bytes of a transform, about, and the most different runs of one core in it: cores with more are widened.
CHUNK_BYTES, GROUP_RUNS = 1 << 20, 20_000
#: Stands for a null doc_id, which comes before all others.
_NULL_ID = -(1 << 63)
#: Positions hashed at a time; also the most that the low bits of an order key can number.
_PIECE = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_UP, _DOWN = _powers(_BASE, _PIECE + 1), _powers(_BASE_INVERSE, _PIECE + 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def core_step(least: int) -> int:
    """How many places of the anchor in a window share a core."""
    return -(-(least - min(GRAM, least) + 1) // CORES)


def runs(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share a core: first start, number of windows, place of the anchor in the first of them, hash of the core.

    Every window of ``least`` bytes has an anchor, its k-gram of least hash (the first of equals), and a core, the
    bytes around the anchor that all windows at about its distance share. Both depend on the window's bytes alone; so
    equal windows have equal cores and the anchor at the same place. Every window lies in exactly one run.
    """
    out: list[tuple[np.ndarray, ...]] = []
    data = np.frombuffer(text, np.uint8)
    gram = min(GRAM, least)
    span = least - gram + 1
    step = core_step(least)
    for lo in range(0, max(len(data) - least + 1, 0), _PIECE - least):
        piece = data[lo : lo + _PIECE]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _UP[: len(piece)], out=sums[1:])
        grams = _mix((sums[gram:] - sums[:-gram]) * _DOWN[: len(piece) - gram + 1])
        order = (grams & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(grams), dtype=np.uint64)
        at = (_sliding_min(order, span) & np.uint64(0xFFFFF)).astype(np.int64)[: _PIECE - least]
        far = (at - np.arange(len(at))) // step
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (far[1:] != far[:-1]))))
        count = np.diff(np.concatenate((first, [len(at)])))
        inner = at[first] - far[first] * step
        core = _mix((sums[inner + least - step + 1] - sums[inner]) * _DOWN[inner] + far[first].astype(np.uint64))
        out.append((first + lo, count, at[first] - first, core.view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` symbols at least; the text ends in its least symbol, 0."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    held = 63 // bits
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(held, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(held):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
        if held >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - held] += rank[held:] + 1
        held *= 2


def long_prefixes(bwt: np.ndarray, least: int) -> np.ndarray:
    """For each place in the suffix order: whether the suffix shares ``least`` symbols or more with the one before.

    Breadth-first backward extension: the intervals of all strings of length 1, 2, … are extended by one symbol to the
    left on the transform, kept as a wavelet matrix; an interval that ends where no common prefix is known yet gives the next
    place its value, and is extended in the next round. Values come in increasing order, so after ``least`` rounds the
    places without one share at least that much. Strings that hold symbol 0 are not followed.
    """
    n, bits = len(bwt), max(1, int(bwt.max()).bit_length())
    counts = np.bincount(bwt, minlength=1 << bits)
    smaller = np.concatenate(([0], np.cumsum(counts)[:-1]))
    zeros, level = [], bwt
    for b in range(bits - 1, -1, -1):
        bit = (level >> b & 1).astype(bool)
        zeros.append(np.concatenate(([0], np.cumsum(~bit))).astype(np.int32))
        level = np.concatenate((level[~bit], level[bit]))
    leaf = np.zeros(1 << bits, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))
    leaf[level[starts]] = starts
    shift = (smaller - leaf).astype(np.int32)

    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(least):
        symbol = np.zeros(len(low), np.int16)
        for z in zeros:
            z_low, z_high = z[low], z[high]
            left = z_high > z_low
            ones_low, ones_high = z[-1] + low - z_low, z[-1] + high - z_high
            right = ones_high > ones_low
            symbol = np.concatenate((symbol[left] << 1, symbol[right] << 1 | 1))
            low = np.concatenate((z_low[left], ones_low[right]))
            high = np.concatenate((z_high[left], ones_high[right]))
        move = shift[symbol]
        low, high = low + move, high + move
        fresh = ~known[high] & (symbol != 0)
        low, high = low[fresh], high[fresh]
        known[high] = True
        if not len(low):
            break
    return ~known[:n]


def repeated_windows(pieces: list[bytes], keys: np.ndarray, windows: np.ndarray, least: int) -> list[np.ndarray]:
    """For each piece, which of its first ``windows`` starts hold ``least`` bytes that start earlier in another piece.

    ``keys`` (pieces × 3: document, text, place of the first byte) say what is earlier.
    """
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    begin = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    gap = np.zeros(len(raw), bool)
    gap[begin + lengths] = True
    used, dense = np.unique(raw[~gap], return_inverse=True)
    text = np.zeros(len(raw), np.int16)
    text[~gap] = dense + 1
    order = suffix_order(text, least)
    joined = long_prefixes(text[order - 1], least)
    group = np.cumsum(~joined)
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    offset = np.arange(len(raw)) - begin[piece]
    valid = offset[order] < windows[piece[order]]
    at, group = order[valid], group[valid]
    size = np.bincount(group)
    shared = size[group] > 1
    at, group = at[shared], group[shared]
    who = piece[at]
    start = keys[who, 2] + offset[at]
    by = np.lexsort((start, keys[who, 1], keys[who, 0], group))
    at, group, who, start = at[by], group[by], who[by], start[by]
    head = np.concatenate(([True], group[1:] != group[:-1])) if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else np.zeros(0, np.int64)
    later = (keys[who, 0] != keys[who[first], 0]) | (keys[who, 1] != keys[who[first], 1]) | (start != start[first])
    flags = np.zeros(len(raw), bool)
    flags[at[later]] = True
    return [flags[b : b + w] for b, w in zip(begin, windows, strict=True)]


def _per_document(fn: Callable[[bytes], tuple[np.ndarray, ...]], keep: list[str], names: list[str], summed: bool = False):
    """Arrow function: ``fn``'s rows for each document, beside the columns in ``keep`` (or, ``summed``, distinct with counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                found = [fn(t.as_py()) for t in part.column("b")]
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                if summed:
                    yield pa.record_batch([pa.array(c) for c in np.unique(columns[0], return_counts=True)], names)
                    continue
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                yield pa.record_batch([*[part.column(k).take(rows) for k in keep], *map(pa.array, columns)], [*keep, *names])

    return run


def _compare(least: int):
    """Arrow function over runs in order of their core: intervals of each run's windows that occur earlier."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        keys = np.array([h[1:4] for h in held], np.int64)
        flags = repeated_windows([h[5] for h in held], keys, np.array([h[4] for h in held]), least)
        d, t, start, end = [], [], [], []
        for (_, a, b, place, _, _), f in zip(held, flags, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], f.view(np.int8), [0]))))
            for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                d.append(a)
                t.append(b)
                start.append(place + lo)
                end.append(place + hi - 1 + least)
        return pa.record_batch([pa.array(x, pa.int64()) for x in (d, t, start, end)], ["d", "t", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("core", "d", "t", "place", "n", "bytes")], strict=True):
                if size >= CHUNK_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    return run


def widened(parts: DataFrame, least: int) -> DataFrame:
    """(d, t, core, place, off, n, lo, width, bytes): each run cut in two where the anchor's place passes the middle of its range, with the wider core of its half.

    All windows of a range [lo, lo + width) of places share least + 1 - width bytes, so halves share more. Equal windows have the anchor at the same place, and
    stay together.
    """
    up = F.ceil(F.col("width") / 2).cast("int")
    middle = F.col("lo") + up
    first = F.least(F.col("n"), F.greatest(F.lit(0), F.col("off") - middle + 1))  # windows whose anchor lies in the upper half
    half = lambda n, skip, lo, width: F.struct(
        (F.col("place") + skip).alias("place"), (F.col("off") - skip).cast("int").alias("off"), n.cast("int").alias("n"), lo.cast("int").alias("lo"), width.cast("int").alias("width"),
        F.substring("bytes", (skip + 1).cast("int"), (n - 1 + least).cast("int")).alias("bytes"),
    )
    both = F.array(half(first, F.lit(0), middle, F.col("width") - up), half(F.col("n") - first, first, F.col("lo"), up))
    cut = parts.select("d", "t", "core", F.explode(F.filter(both, lambda h: h["n"] > 0)).alias("h")).select("d", "t", "core", "h.*")
    shared = F.substring("bytes", (F.col("off") - F.col("lo") + 1).cast("int"), (least + 1 - F.col("width")).cast("int"))
    return cut.withColumn("core", F.xxhash64("core", "lo", shared))


def _cut(b: bytes, spans: list) -> tuple[int, int, str]:
    """Removed bytes, maximal removed runs and SHA-256 of the rest, for (start, end) in any order."""
    removed = count = at = 0
    digest = hashlib.sha256()
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if count == 0 or start > at:
            digest.update(b[at:start])
            count += 1
            at = start
        removed += max(0, end - max(at, start))
        at = max(at, end)
    digest.update(b[at:])
    return removed, count, digest.hexdigest()


def _first() -> Column:
    return F.min(F.struct("d", "t", "place"))


def repeats(rows: DataFrame, scratch: Scratch, least: int) -> DataFrame:
    """(d, t, b) to (d, t, start, end): intervals that cover exactly the bytes of windows that occurred earlier.

    Texts are hashed twice, to count cores and to list the runs of those that are shared: a list of all runs would be larger than the texts.
    """
    cores = rows.select("b").mapInArrow(
        _per_document(lambda b: (runs(b, least)[3],), [], ["core", "c"], summed=True), "core long, c long"
    )
    shared = scratch.write(cores.groupBy("core").agg(F.sum("c").alias("c")).filter("c > 1").select("core"), "cores")
    step = core_step(least)

    def parts(b: bytes) -> tuple[np.ndarray, ...]:
        start, n, off, core = runs(b, least)
        whole = [xxhash.xxh3_64_intdigest(b[i:j]) for i, j in zip(start.tolist(), (start + n - 1 + least).tolist(), strict=True)]
        return core, np.array(whole, np.uint64).view(np.int64), start << 16 | off << 8 | n

    found = rows.mapInArrow(
        _per_document(parts, ["d", "t"], ["core", "whole", "place"]), "d long, t long, core long, whole long, place long"
    )
    found = scratch.write(found.join(shared, "core", "left_semi"), "runs")
    bits = lambda c, shift: F.shiftright(c, shift).bitwiseAND(F.lit(255)).cast("int")
    start = F.shiftright("place", 16)
    classes = found.groupBy("core", "whole").agg(_first().alias("first"), F.count(F.lit(1)).alias("m"))
    classes = scratch.write(classes, "classes")
    copies = found.join(classes.filter("m > 1").select("core", "whole", "first"), ["core", "whole"]).filter(
        F.struct("d", "t", "place") != F.col("first")
    )
    spans = [copies.select("d", "t", start.alias("start"), (start + bits("place", 0) - 1 + least).alias("end"))]

    groups = classes.groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    distinct = classes.join(groups, "core").select("core", "k", "first.*")
    wanted = distinct.groupBy("d", "t").agg(F.collect_list(F.struct("core", "k", "place")).alias("runs"))
    texts = rows.join(wanted, ["d", "t"]).select("d", "t", "b", F.explode("runs").alias("r")).select("d", "t", "r.core", "r.k", "r.place", "b")
    n, off = bits("place", 0), bits("place", 8)
    texts = texts.select(
        "d", "t", "core", "k", start.alias("place"), off.alias("off"), n.alias("n"), (F.floor(off / step) * step).cast("int").alias("lo"), F.lit(step).alias("width"),
        F.substring("b", (start + 1).cast("int"), (n - 1 + least).cast("int")).alias("bytes"),
    )
    texts = scratch.write(texts, "bytes")
    while True:
        fit = texts.filter(F.col("k") <= GROUP_RUNS).select("core", "d", "t", "place", "n", "bytes")
        spans.append(fit.repartition("core").sortWithinPartitions("core").mapInArrow(_compare(least), "d long, t long, start long, end long"))
        large = texts.filter(F.col("k") > GROUP_RUNS)
        if large.isEmpty():
            break
        cut = scratch.write(widened(large, least), "halves")
        kind = ["core", "off", "n", "lo", "width", "bytes"]
        classes = scratch.write(cut.groupBy(*kind).agg(_first().alias("first"), F.count(F.lit(1)).alias("m")), "kinds")
        again = cut.join(classes.filter("m > 1").select(*kind, "first"), kind).filter(F.struct("d", "t", "place") != F.col("first"))
        spans.append(again.select("d", "t", F.col("place").alias("start"), (F.col("place") + F.col("n") - 1 + least).alias("end")))
        groups = classes.groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        texts = scratch.write(classes.join(groups, "core").select("first.d", "first.t", "core", "k", "first.place", "off", "n", "lo", "width", "bytes"), "bytes")
    return reduce(DataFrame.union, spans)


def deduplicate(docs: DataFrame, least: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``least`` bytes that covers it also starts earlier: in a smaller doc_id, or before in the same
    document. A null text counts as empty; a null doc_id comes before all others and counts as -2^63. Rows that share a doc_id are in the order of a
    hash of their texts; repeated rows count as one document, and each gets its result. Other columns are not
    read; an empty table returns none.
    """
    if least < 8 or least - 1 + min(GRAM, least) > 255:
        raise ValueError("the least length must lie between 8 and 236 bytes")
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("d"), text_bytes().alias("b")
    )
    single = rows.groupBy("d").count().filter("count > 1").isEmpty()
    rows = rows.withColumn("t", F.lit(0).cast("long") if single else F.xxhash64("b"))
    spans = repeats(rows.select("d", "t", "b"), scratch, least)
    of_doc = spans.groupBy("d", "t").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_cut(b, s or []) for b, s in zip((x.as_py() for x in batch.column("b")), (x.as_py() for x in batch.column("spans")), strict=True)]
            removed, count, sha = zip(*found, strict=True) if found else ((), (), ())
            sizes = pa.array([x.as_buffer().size for x in batch.column("b")], pa.int64())
            yield pa.record_batch(
                [batch.column("doc_id"), sizes, pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.join(of_doc, ["d", "t"], "left").select("doc_id", "b", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
