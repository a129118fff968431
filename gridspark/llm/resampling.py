"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target.

Each block of a partition becomes one sequence of word ids with a suffix array over it, ordered by the first ``width``
words. Runs of equal common prefixes in it are the n-grams that repeat: each run is hashed once, and its bucket is
scattered back to all places where the n-gram stands. What a document's places hold is kept as packed bucket ids; so
the texts are read and hashed once, and counting and scoring go over the ids alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import FOLDED, Scratch, text_bytes

#: Bytes of text in one suffix array, at which a block ends; a longer text is a block of its own. Results don't depend on it.
BLOCK_BYTES = 8 << 20


def suffix_order(ids: np.ndarray, width: int) -> np.ndarray:
    """The places of ``ids`` (separators are 0), ordered by the first ``width`` ids from each place on."""
    rank, depth = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while depth < width:  # ranks by ``depth`` ids give ranks by twice as many
        ahead = np.zeros_like(rank)
        ahead[: max(len(rank) - depth, 0)] = rank[depth:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        depth *= 2
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """How many ids each place of ``order`` shares with the one before it, ``width`` at most and none across a separator."""
    shared = np.zeros(len(order), np.int64)
    same = np.ones(max(len(order) - 1, 0), bool)
    padded = np.append(ids, np.zeros(width, ids.dtype))
    for k in range(width):
        here = padded[order + k]
        same &= (here[1:] == here[:-1]) & (here[1:] != 0)
        shared[1:] += same
    return shared


class Block:
    """Documents as ids of their words, with a separator (0) behind each; words are held once."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]
        self.parts: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.translate(FOLDED).split()
        for w in set(words).difference(self.numbers):
            self.numbers[w] = len(self.words)
            self.words.append(w)
        self.parts += [np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
        self.lengths.append(len(words))
        self.size += len(text)

    def gram_buckets(self, width: int, buckets: int) -> list[np.ndarray]:
        """For each document the buckets of all its runs of 1 to ``width`` words: those of single words first, in order of place."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        order = suffix_order(ids, width)
        shared = common_prefixes(ids, order, width)
        lengths = np.array(self.lengths, np.int64)
        stops = np.cumsum(lengths + 1) - 1  # where the documents' separators stand
        ends = np.repeat(stops, lengths + 1)
        found: list[list[np.ndarray]] = [[] for _ in self.lengths]
        for n in range(1, width + 1):
            whole = ends[order] - order >= n  # n words from here on are in the document
            places, opens = order[whole], (shared < n)[whole]
            at = ids[places[opens][:, None] + np.arange(n)].tolist()
            hashed = np.fromiter((zlib.crc32(b" ".join([self.words[i] for i in g])) % buckets for g in at), np.int64, len(at))
            scattered = np.zeros(len(ids), _packed(buckets))
            scattered[places] = hashed[np.cumsum(opens) - 1]
            for k, (stop, length) in enumerate(zip(stops.tolist(), self.lengths, strict=True)):
                found[k].append(scattered[stop - length : max(stop - n + 1, stop - length)])
        return [np.concatenate(f) for f in found]


def _packed(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, key: str, width: int = 1, buckets: int = 10_000) -> DataFrame:
    """(``key``, text) to (id, n_words, n_features, packed): the bucket of every feature of every whole text, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(ids: list, block: Block) -> pa.RecordBatch:
            found = block.gram_buckets(width, buckets)
            return pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(block.lengths, pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([f.tobytes() for f in found], pa.binary()),
                ],
                ["id", "n_words", "n_features", "packed"],
            )

        ids, block = [], Block()
        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t"), strict=True):
                ids.append(i)
                block.add(t.as_py())
                if block.size >= BLOCK_BYTES:
                    yield close(ids, block)
                    ids, block = [], Block()
        yield close(ids, block)

    rows = docs.select(F.col(key).cast("long").alias("id"), text_bytes().alias("t"))
    return rows.mapInArrow(run, "id long, n_words long, n_features long, packed binary")


def bucket_counts(stored: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features fall into each bucket. Each task sums before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("packed"):
                counts += np.bincount(np.frombuffer(packed.as_py(), _packed(buckets)), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    return stored.select("packed").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))) of each bucket; ``buckets`` numbers reach the driver."""
    spark = source.sparkSession
    of = lambda counts, name: counts.select("bucket", F.col("n").alias(name))
    every = (
        spark.range(buckets).withColumnRenamed("id", "bucket")
        .join(of(source, "s"), "bucket", "left").join(of(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
        .cache()
    )
    try:
        total = every.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
        up = (F.col("t") + 1).cast("double") * float(total.s + buckets)
        down = (F.col("s") + 1).cast("double") * float(total.t + buckets)
        rows = every.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain")).collect()
    finally:
        every.unpersist()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.gain
    return out


def weights(stored: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = []
            for packed in batch.column("packed"):
                own = np.frombuffer(packed.as_py(), _packed(len(gain)))
                means.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            columns = [batch.column(c) for c in ("id", "n_words", "n_features")]
            yield pa.record_batch([*columns, pa.array(means, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return stored.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def score(weighted: DataFrame, seed: int = 2024) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise in thousandths, drawn from a hash of ``seed`` and doc_id, so that reruns agree."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weighted.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, scratch: Scratch, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Adds ``rank`` 1, 2, 3 … to the ``percent`` of the documents of ``least_words`` words with the highest scores; others get none.

    Ranges of scores are sorted on their own and begin where the counts of the ranges before them end; no task holds more than a range.
    """
    rows = scratch.write(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least_words
    #: Rows of one id may have equal scores; ``row`` lets ranges cut between them.
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ordered = scratch.write(
        rows.filter(fit).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()),
        "ordered",
    )
    shard = F.shiftrightunsigned("at", 33)
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    shards = ordered.groupBy(shard.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    starts = shards.select("s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    total = ordered.count()
    rank = F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    #: One row for each range, of which there are as many as shuffle partitions.
    ranked = ordered.join(F.broadcast(starts), shard == F.col("s")).withColumn("rank", F.when(rank <= total * percent // 100, rank))
    rest = rows.filter(~fit).withColumn("rank", F.lit(None).cast("long"))
    names = [*scored.columns, "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))


def resample(
    docs: DataFrame, target: DataFrame, target_key: str = "item_id", width: int = 1, buckets: int = 10_000,
    percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score and rank (null where the row is not drawn).

    Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII; features are all runs of 1 to
    ``width`` words, repeats counted, in ``buckets`` buckets by crc32. A null text counts as empty: no features, weight 0. Null
    doc_ids draw as an empty id and come last in ties; repeated rows each have a row and a rank of their own; other columns
    are not read; an empty table gives no rows, and an empty target equal counts of 0 for it.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    stored = scratch.write(features(docs, "doc_id", width, buckets), "features")
    aim = features(target, target_key, width, buckets)
    gain = gains(bucket_counts(stored, buckets), bucket_counts(aim, buckets), buckets)
    return draw(score(weights(stored, gain), seed), scratch, percent, least_words)
