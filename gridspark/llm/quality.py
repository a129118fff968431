"""Document statistics, and gradient-boosted trees over them that judge a document's quality.

The trees are grown on a bounded sample of labelled rows (``max_train_rows``), with monotonic constraints on the
statistics that can only speak against a document. They are kept as flat numpy arrays, so a batch of documents
walks down all trees at once. Statistics cover every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import as_struct, from_struct, text_bytes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Model inputs, and the direction in which each may move the score (-1: only down; 0: free).
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "exclaim_per_word": -1,
    "digit_share": -1,
    "distinct_share": 0,
    "words_per_line": 0,
    "stop_per_line": 0,
    "short_word_share": 0,
}
_ASCII_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_CONTINUATION = bytes(range(0x80, 0xC0))


def _count(text: bytes, kinds: bytes) -> int:
    return len(text) - len(text.translate(None, kinds))


def _repeated(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """Words that lie in a window of ``width`` words found twice or more, and the number of distinct words."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(words) - width + 1
    if n < 2:
        return 0, len(numbers)
    window = ids[:n]
    for k in range(1, width):
        if k > 1:  # the pairs so far as small numbers, so that the product stays within 64 bits
            window = np.unique(window, return_inverse=True)[1]
        window = window * len(numbers) + ids[k : k + n]
    _, back, times = np.unique(window, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(times[back] > 1)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1]))), len(numbers)


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five counts of the contract and the model's inputs, for one whole UTF-8 text."""
    words = text.split()
    n = len(words)
    chars = len(text) - _count(text, _ASCII_SPACE) - _count(text, _CONTINUATION)
    symbols = _count(text, _SYMBOLS)
    seen: set[bytes] = set()
    filled = dup = 0
    for line in text.split(b"\n"):
        if line.strip(_ASCII_SPACE):
            filled += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat, distinct = _repeated(words)
    per_word, letters = max(n, 1), max(_count(text, _LOWER) + _count(text, _UPPER), 1)
    inputs = [
        np.log1p(n),
        chars / per_word,
        symbols / per_word,
        dup / max(filled, 1),
        repeat / per_word,
        _count(text, _UPPER) / letters,
        text.count(b"!") / per_word,
        _count(text, _DIGITS) / max(chars, 1),
        distinct / per_word,
        n / max(filled, 1),
        text.count(b".") / max(filled, 1),
        sum(1 for w in words if len(w) <= 3) / per_word,
    ]
    return [n, chars, symbols, dup, repeat], inputs


@dataclass
class Trees:
    """Trees as arrays of (tree, node): leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of inputs."""
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(goes_left, self.left[tree, node], self.right[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(axis=1))))


def grow(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 48, ridge: float = 1.0, least: int = 8,
) -> Trees:
    """Boosted trees for the logistic loss on quantile histograms.

    A split on a constrained input is taken only if its two values are in order, and the values below it stay on
    their own side of the middle between both; so the score is monotonic in that input. With fewer than two classes the score
    is constant.
    """
    n_nodes = 2 ** (depth + 1) - 1
    shape = (trees, n_nodes)
    flat = Trees(
        np.zeros(shape, np.int64), np.zeros(shape), np.tile(np.arange(n_nodes), (trees, 1)),
        np.tile(np.arange(n_nodes), (trees, 1)), np.zeros(shape), 0.0, depth,
    )
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.999
    flat.base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return flat
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    raw = np.full(len(y), flat.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for level in range(depth + 1):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                if node not in bounds:
                    continue
                here = np.flatnonzero(at == node)
                low, high = bounds[node]
                G, H = g[here].sum(), h[here].sum()
                flat.value[t, node] = rate * np.clip(-G / (H + ridge), low, high)
                best = (1e-6, -1, 0, 0.0)
                for f in range(x.shape[1]) if level < depth and len(here) >= 2 * least else ():
                    k, size = binned[here, f], len(cuts[f]) + 1
                    gl = np.cumsum(np.bincount(k, g[here], size))[:-1]
                    hl = np.cumsum(np.bincount(k, h[here], size))[:-1]
                    nl = np.cumsum(np.bincount(k, minlength=size))[:-1]
                    if not len(gl):
                        continue
                    vl = np.clip(-gl / (hl + ridge), low, high)
                    vr = np.clip(-(G - gl) / (H - hl + ridge), low, high)
                    gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                    bad = (nl < least) | (len(here) - nl < least) | (signs[f] * (vr - vl) < 0)
                    gain[bad] = -np.inf
                    j = int(np.argmax(gain))
                    if gain[j] > best[0]:
                        best = (float(gain[j]), f, j, float((vl[j] + vr[j]) / 2))
                _, f, j, middle = best
                if f < 0:
                    continue
                l, r = 2 * node + 1, 2 * node + 2
                flat.feature[t, node], flat.threshold[t, node] = f, cuts[f][j]
                flat.left[t, node], flat.right[t, node] = l, r
                at[here] = np.where(binned[here, f] <= j, l, r)
                bounds[l] = (low, min(high, middle)) if signs[f] > 0 else (max(low, middle), high) if signs[f] < 0 else (low, high)
                bounds[r] = (max(low, middle), high) if signs[f] > 0 else (low, min(high, middle)) if signs[f] < 0 else (low, high)
        raw = raw + flat.value[t, at]
    return flat


def document_statistics(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, the counts, and ``inputs`` as an array of doubles."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column("t")]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    *[pa.array(c) for c in counts.T.copy()],
                    pa.array([list(map(float, i)) for _, i in found], pa.list_(pa.float64())),
                ],
                ["doc_id", *COUNTS, "inputs"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", inputs array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(measure, schema)


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 4000) -> Trees:
    """Trees from at most ``max_train_rows`` labelled rows, the smallest by a hash of doc_id; only they are collected."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = (
        document_statistics(sample)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "inputs", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "inputs")
        .limit(max_train_rows)
        .collect()
    )
    x = np.array([r.inputs for r in rows], float).reshape(-1, len(FEATURES))
    return grow(x, np.array([r.quality for r in rows], float), list(FEATURES.values()))


def _verdict(threshold: float, min_words: int, max_repeat: float):
    """The base rule and the rule of both, as columns."""
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return failed, ~failed & (F.col("score") >= threshold)


def judge(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.35, min_words: int = 50, max_repeat: float = 0.5,
    max_train_rows: int = 4000,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, score and kept.

    A null text counts as empty and fails the base rule; null doc_ids and repeated rows keep their rows; other
    columns are not read; an empty table returns none. Without labels of both classes the base rule alone decides. A score equal to
    ``threshold`` is kept.
    """
    trees = train(docs, labels, max_train_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("inputs").to_pylist(), float).reshape(-1, len(FEATURES))
            keep = [c for c in batch.schema.names if c != "inputs"]
            yield pa.record_batch(
                [*[batch.column(c) for c in keep], pa.array(trees.score(x))], [*keep, "score"]
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    failed, kept = _verdict(threshold, min_words, max_repeat)
    return (
        document_statistics(docs)
        .mapInArrow(score, schema)
        .withColumn("base_failed", failed)
        .withColumn("kept", kept)
    )


def select_good(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.35, min_words: int = 50, max_repeat: float = 0.5,
    max_train_rows: int = 4000,
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, in one pass and without a shuffle.

    A null text counts as empty and goes; null doc_ids and repeated rows stay as often as they come; columns may have any names; an empty table gives no rows.
    """
    trees = train(docs, labels, max_train_rows)
    rows = as_struct(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics((t or "").encode()) for t in batch.column("d").field("text").to_pylist()]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            score = trees.score(np.array([i for _, i in found], float).reshape(-1, len(FEATURES)))
            good = (counts[:, 0] >= min_words) & (counts[:, 4] <= max_repeat * counts[:, 0]) & (score >= threshold)
            yield batch.filter(pa.array(good))

    return from_struct(rows.mapInArrow(keep, rows.schema), docs.columns)
