"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, hashed into a fixed number of buckets; the machine has a weight and a
vector for each bucket that speaks about the label, and adds the product of the vectors of every two terms that meet in a
text. So an insult may count for more beside the mention of a group than both add up to. It is fitted with numpy on a bounded
sample of labelled rows; all other rows are scored in Arrow tasks, whole text by whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import FOLDED, Scratch, text_bytes

#: Labelled rows of the fit, buckets of terms, and the buckets among them that the machine keeps, at most.
MAX_TRAIN_ROWS, BUCKETS, MAX_TERMS = 8000, 1 << 18, 4096
#: Documents of the fit that a kept bucket stands in at least, and the least log-likelihood ratio between it and the label.
LEAST_DOCS, LEAST_GAIN = 4, 3.0
#: Lengths in characters of the beginnings of words that are terms beside the whole words.
BEGINNINGS = range(3, 9)
#: Words whose terms a task remembers.
REMEMBERED = 400_000


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row's label must not be learnt: crc32 of its id as text divides by ``folds``; null counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def word_terms(word: bytes) -> set[int]:
    """Buckets of a word (its UTF-8 bytes) and of its beginnings."""
    letters = word.decode("utf-8", "replace")
    starts = [b"^" + letters[:k].encode() for k in BEGINNINGS if k < len(letters)]
    return {zlib.crc32(t) % BUCKETS for t in [b"=" + word, *starts]}


class Terms:
    """Distinct terms of whole texts; with ``kept`` only those, as their positions in it."""

    def __init__(self, kept: np.ndarray | None = None) -> None:
        self.at = None if kept is None else {b: i for i, b in enumerate(kept.tolist())}
        self.known: dict[bytes, frozenset[int]] = {}

    def _of(self, word: bytes) -> frozenset[int]:
        terms = word_terms(word)
        return frozenset(terms if self.at is None else {self.at[t] for t in terms if t in self.at})

    def __call__(self, text: bytes) -> np.ndarray:
        words = set(text.translate(FOLDED).split())
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known.update((w, self._of(w)) for w in words.difference(self.known))
        terms = frozenset().union(*map(self.known.__getitem__, words))
        return np.sort(np.fromiter(terms, np.int64, len(terms)))


def _rows(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` in each row of a matrix given by its row starts; rows may be empty."""
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return run[starts[1:]] - run[starts[:-1]]


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of positions as one array and the starts of rows in it."""
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), starts


@dataclass
class Machine:
    """A factorization machine over ``kept`` buckets: bias, weights (n) and factors (n, k)."""

    kept: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of bias, weights and pairs of each row, and its sum of factors."""
        own = self.factors[at]
        total = _rows(own, starts)
        pairs = 0.5 * ((total**2).sum(axis=1) - _rows((own**2).sum(axis=1), starts))
        return self.bias + _rows(self.weights[at], starts) + pairs, total

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*_joined(rows))[0], -30, 30)))


def fit(
    kept: np.ndarray, rows: list[np.ndarray], y: np.ndarray, rank: int = 8, epochs: int = 12, batch: int = 256,
    rate: float = 0.1, ridge: float = 1e-5, ridge_factors: float = 1e-4, seed: int = 7,
) -> Machine:
    """Adaptive gradient steps on the logistic loss; ``rank`` 0 leaves the weights alone. Without both labels the score is constant."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
    rng = np.random.default_rng(seed)
    n = len(kept)
    m = Machine(kept, float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, 0.02, (n, rank)))
    if not len(y) or y.min() == y.max():
        m.factors[:] = 0
        return m
    past_w, past_v, past_b = np.full(n, 1e-8), np.full((n, rank), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for first in range(0, len(order), batch):
            chosen = order[first : first + batch]
            at, starts = _joined([rows[i] for i in chosen])
            raw, total = m.raw(at, starts)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[chosen]) / len(chosen)
            row = np.repeat(np.arange(len(chosen)), np.diff(starts))
            step_w = np.bincount(at, error[row], n) + ridge * m.weights
            step_v = ridge_factors * m.factors
            np.add.at(step_v, at, error[row][:, None] * (total[row] - m.factors[at]))
            past_w += step_w**2
            past_v += step_v**2
            past_b += error.sum() ** 2
            m.weights -= rate * step_w / np.sqrt(past_w)
            m.factors -= rate / 2 * step_v / np.sqrt(past_v)
            m.bias -= rate / 2 * error.sum() / np.sqrt(past_b)
    return m


def telling(counts: DataFrame, n: int, toxic: int) -> np.ndarray:
    """Of (term, docs, toxic) the MAX_TERMS terms with the greatest log-likelihood ratio with the label, ascending."""

    def part(seen: Column, due: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / due)).otherwise(F.lit(0.0))

    d, t, share = F.col("docs"), F.col("toxic"), toxic / max(n, 1)
    ratio = (
        part(t, d * share) + part(d - t, d * (1 - share))
        + part(toxic - t, (n - d) * share) + part((n - d) - (toxic - t), (n - d) * (1 - share))
    )
    best = (
        counts.filter(d >= LEAST_DOCS).withColumn("ratio", F.round(ratio, 6)).filter(F.col("ratio") >= LEAST_GAIN)
        .orderBy(F.col("ratio").desc(), "term").limit(MAX_TERMS).collect()
    )
    return np.array(sorted(r.term for r in best), np.int64)


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> Machine:
    """A machine from at most ``max_train_rows`` labelled rows, the smallest by a hash of doc_id, none of them held out.

    Labels that differ for one id count as toxic; of the texts of one id the smallest is learnt. Only the kept terms of these rows are collected.
    """
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    )
    one = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))
    )

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Terms()
        for batch in batches:
            rows = [found(t.as_py()).astype(np.int32) for t in batch.column("t")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    scratch = Scratch(spark, "toxicity")
    sample = scratch.write(one.mapInArrow(terms, "doc_id long, toxic int, terms array<int>"), "sample")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    counts = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("toxic").alias("toxic"))
    kept = telling(counts, total.n, total.toxic)
    own = F.array_intersect("terms", F.lit(kept.astype(np.int32).tolist()) if len(kept) else F.array().cast("array<int>"))
    rows = sorted((r.doc_id, r.toxic, r.terms) for r in sample.select("doc_id", "toxic", own.alias("terms")).collect())
    places = [np.sort(np.searchsorted(kept, np.array(r[2], np.int64))) for r in rows]
    return fit(kept, places, np.array([r[1] for r in rows], float))


def judge(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 at ``threshold`` or more).

    The text alone makes the score. A null text counts as empty and gets a score too; null ids are held out and keep their rows, as repeated rows do; other
    columns are not read; an empty table gives no rows. Without labels of both kinds every score is the share of toxic
    labels, between 0.001 and 0.999.
    """
    machine = train(docs, labels, max_train_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.kept)
        for batch in batches:
            found = machine.score([terms(t.as_py()) for t in batch.column("t")])
            yield pa.record_batch([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    return rows.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
