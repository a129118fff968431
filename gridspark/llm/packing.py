"""Optimal length buckets and token-budget batches.

Dynamic programming over the histogram of all lengths places the bucket boundaries so that padding every piece to
its bucket's boundary adds the fewest tokens. Inside a bucket, pieces fill batches of equal shape.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, rank_in_groups
from gridspark.llm.mixing import word_count

#: Pieces in one shard of a bucket, about.
SHARD_ROWS = 200_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` boundaries, each one of ``lengths`` (ascending), of least total padding.

    Cost of a bucket that ends at length b: the sum of count × (b − length) over its lengths. Of equally good
    choices, that with the smaller boundaries wins.
    """
    n = len(lengths)
    if not n:
        return []
    length = lengths.astype(np.int64)
    rows = np.concatenate(([0], np.cumsum(counts.astype(np.int64))))
    words = np.concatenate(([0], np.cumsum(counts.astype(np.int64) * length)))
    best = length * rows[1:] - words[1:]
    back = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, came = best.copy(), np.full(n, -1, np.int64)
        for b in range(1, n):
            cost = best[:b] + length[b] * (rows[b + 1] - rows[1 : b + 1]) - (words[b + 1] - words[1 : b + 1])
            a = int(np.argmin(cost))
            if cost[a] < new[b]:
                new[b], came[b] = cost[a], a
        best = new
        back.append(came)
    found, at = [], n - 1
    for layer in reversed(range(len(back))):
        if layer and back[layer][at] < 0:
            continue
        found.append(int(length[at]))
        if layer == 0:
            break
        at = int(back[layer][at])
    return found[::-1]


def pieces(docs: DataFrame, max_len: int, length: Column | None = None) -> DataFrame:
    """(row, doc_id, piece, start, length): whole texts cut at every ``max_len`` units of ``length``; an empty text is one empty piece.

    ``row`` numbers the input's rows, so that copies of a document can be told apart once the pieces are written.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("words") / max_len)).cast("int")
    return (
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (word_count() if length is None else length.cast("long")).alias("words"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("start", F.col("piece").cast("long") * max_len)
        .select("row", "doc_id", "piece", "start", F.least(F.lit(max_len), F.col("words") - F.col("start")).cast("int").alias("length"))
    )


def pack(docs: DataFrame, buckets: int = 8, max_len: int = 2048, budget: int = 16384, length: Column | None = None) -> DataFrame:
    """One row per piece: row, doc_id, piece, start, length, bucket_len, batch, slot.

    ``length`` is a column of ``docs`` with the documents' lengths, such as the sizes of their token ids; without it words count.
    All pieces of a batch (bucket_len, batch) share a boundary, and slots × boundary never exceeds ``budget``; only
    the last batch of a bucket may be short. The histogram has at most ``max_len`` + 1 rows. Null texts count as
    empty; null doc_ids and repeated rows are packed like others; an empty table gives no rows.
    """
    if not 0 < max_len <= budget:
        raise ValueError("a batch must hold at least one piece of max_len words")
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.write(pieces(docs, max_len, length), "pieces")
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = sorted((r.length, r.n) for r in histogram)
    lengths, counts = (np.array([h[i] for h in histogram], np.int64) for i in (0, 1))
    ends = optimal_boundaries(lengths, counts, buckets) or [max_len]
    bucket = F.array_min(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e >= F.col("length")))
    ranked = rank_in_groups(
        cut.withColumn("bucket_len", bucket), ["bucket_len"], ["doc_id", "row", "piece"], 1 + int(counts.sum()) // SHARD_ROWS, "at"
    )
    slots = F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))).cast("long")
    return ranked.select(
        "row", "doc_id", "piece", "start", "length", "bucket_len",
        F.floor(F.col("at") / slots).cast("long").alias("batch"),
        F.pmod(F.col("at"), slots).cast("int").alias("slot"),
    )
