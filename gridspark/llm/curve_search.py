"""Nearest neighbours by largest inner product, from several shifted Hilbert orderings.

Vectors are lifted onto a sphere (so that the largest inner product is the smallest distance), projected at random
and shifted, and ordered along a Hilbert curve; each ordering has a projection and a shift of its own. Every
ordering is cut into key ranges. A query looks at the range of its own key and at the two beside it, in every
ordering; what it finds there is scored exactly and merged. How wide the ranges must be is measured: a bounded
sample of queries is searched by brute force, and the width is set so that the windows hold ``aim`` of what
brute force finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, about

DIMS, BITS = 12, 5
#: Sizes, about, of the samples that are collected: distinct vectors for the ranges, queries for the width. They are chosen by a hash.
KEY_SAMPLE, QUERY_SAMPLE = 20_000, 192
#: Found rows kept beyond what a query needs, before the last scoring.
SPARE = 8
#: Most rows and queries, on average, that meet in one group.
CHUNK_ROWS, CHUNK_QUERIES = 8192, 2048


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``cells`` (rows × dims, 0 … 2**bits − 1).

    Bit planes from the top: each plane's bits are turned by the plane above (exchange or inversion of axes), and
    the Gray code of all planes' bits is undone by running exclusive ors.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            inverted = (x[d] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> level) & 1
    return key


@dataclass
class Curves:
    """Projections, shifts and scales of the orderings."""

    planes: np.ndarray
    low: np.ndarray
    width: np.ndarray
    norm: float

    @classmethod
    def fit(cls, sample: np.ndarray, norm: float, count: int, seed: int) -> Curves:
        rng = np.random.default_rng(seed)
        size = sample.shape[1] + 1
        planes = rng.normal(size=(count, size, DIMS))
        for k in range(count):
            q = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :DIMS]
            planes[k, :, : q.shape[1]] = q
        seen = np.einsum("nd,cdk->cnk", _lift(sample, norm), planes)
        middle, spread = seen.mean(axis=1), np.maximum(seen.std(axis=1), 1e-9)
        shift = rng.uniform(-0.5, 0.5, size=middle.shape)
        return cls(planes, middle - (3 + shift) * spread, 6 * spread / (1 << BITS), norm)

    def keys(self, lifted: np.ndarray) -> np.ndarray:
        """Keys of lifted vectors, one column for each ordering."""
        out = []
        for plane, low, width in zip(self.planes, self.low, self.width, strict=True):
            cells = np.clip(np.floor((lifted @ plane - low) / width), 0, (1 << BITS) - 1)
            out.append(hilbert(cells.astype(np.int64), BITS))
        return np.stack(out, axis=1)


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    """Rows with one more coordinate, all of length ``norm``."""
    return np.concatenate((x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))[:, None]), axis=1)


def _aim(x: np.ndarray, norm: float) -> np.ndarray:
    """Queries on the same sphere: scaled to ``norm``, the added coordinate 0."""
    length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.concatenate((x * (norm / length), np.zeros((len(x), 1))), axis=1)


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow or pandas column of equally long lists."""
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy().astype(float).reshape(len(column), -1)
    return np.stack(column.tolist()).astype(float)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores, the columns of the k largest, ties to the smaller id; none that ties is lost."""
    k = min(k, scores.shape[1])
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    for i, row in enumerate(scores):
        at = np.flatnonzero(row >= floor[i])
        yield i, at[np.lexsort((ids[at], -row[at]))][:k]


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors that take part: not null, of the most common length, all finite, not all zero."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"))
    return rows.filter(fine & F.exists("v", lambda v: v != 0))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: (cid, v, ids, asked): the k + 1 smallest ids of each, which is all that k neighbours of any
    query can need, and whether a query has the vector. cid is the smallest id."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    ids = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return ids.select(F.col("ids")[0].alias("cid"), "v", "ids")


def search(vectors: DataFrame, k: int = 20, every: int = 20, curves: int = 16, aim: float = 0.96, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, its k nearest found.

    Nearness is the inner product in double precision, ties to the smaller vec_id; the query's own row is no
    candidate. Equal vectors are searched once, however many they are. Vectors that are null, zero, hold a null or a
    non-finite number, or have another length than the most common one (ties: the longest) take no part; nor do rows
    with a null vec_id. Repeated rows count once. An empty table returns none; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "curves")
    usable = _usable(vectors)
    usual = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    usable = usable.filter(F.size("v") == (usual.n if usual else 0)).distinct()
    classes = scratch.write(_classes(usable, k), "classes")
    asked = usable.filter(F.col("vec_id") % every == 0)
    queries = scratch.write(asked.groupBy("v").agg(F.min("vec_id").alias("qid")), "queries")
    rows = classes.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).alias("norm")
    ).first()
    n_queries = queries.count()
    if not rows.n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    sample = classes.select("cid", "v").filter(about(KEY_SAMPLE, rows.n, "cid")).collect()
    known = np.array([r.v for r in sorted(sample)], float)
    fit = Curves.fit(known, rows.norm, curves, seed)
    keys = np.sort(fit.keys(_lift(known, rows.norm)), axis=0)
    width = _width(classes, queries.filter(about(QUERY_SAMPLE, n_queries, "qid")), fit, keys, k, aim, rows.n)
    cuts = max(1, min(int(1 / width), len(keys)))
    ends = keys[(np.arange(1, cuts) * len(keys)) // cuts]

    row_salts = max(1, -(-rows.n // (cuts * CHUNK_ROWS)))
    query_salts = max(1, -(-3 * n_queries // (cuts * CHUNK_QUERIES)))

    def place(lift, spread: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column("v"))
                got = fit.keys(lift(v, fit.norm))
                for c in range(got.shape[1]):
                    at = np.searchsorted(ends[:, c], got[:, c], side="right")
                    for step in (-1, 0, 1) if spread else (0,):
                        ok = np.flatnonzero((at + step >= 0) & (at + step < cuts))
                        picked = batch.take(pa.array(ok))
                        yield pa.record_batch(
                            [
                                picked.column("id"), picked.column("v"),
                                pa.array(np.full(len(ok), c, np.int32)), pa.array((at[ok] + step).astype(np.int32)),
                            ],
                            ["id", "v", "curve", "cut"],
                        )

        return run

    form = "id long, v array<double>, curve int, cut int"
    salt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every_salt = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = classes.select(F.col("cid").alias("id"), "v").mapInArrow(place(_lift, False), form)
    data = data.withColumn("row_salt", salt(row_salts)).withColumn("query_salt", every_salt(query_salts))
    looking = queries.select(F.col("qid").alias("id"), "v").mapInArrow(place(_aim, True), form)
    looking = looking.withColumn("query_salt", salt(query_salts)).withColumn("row_salt", every_salt(row_salts))
    group = ["curve", "cut", "row_salt", "query_salt"]

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(d):
            ids, qids, m, qm = d.id.to_numpy(), q.id.to_numpy(), _matrix(d.v), _matrix(q.v)
            for lo in range(0, len(q), 256):
                scores = qm[lo : lo + 256] @ m.T
                for i, at in _best(scores, ids, k + 1):
                    found.append((np.full(len(at), qids[lo + i]), ids[at], scores[i, at]))
        if not found:
            return pd.DataFrame({"qid": np.array([], np.int64), "cid": np.array([], np.int64), "score": np.array([], float)})
        qid, cid, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"qid": qid, "cid": cid, "score": score})

    met = looking.groupBy(*group).cogroup(data.groupBy(*group)).applyInPandas(meet, "qid long, cid long, score double")
    merged = met.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    top = merged.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1 + SPARE).select("qid", "cid")
    #: Blocks of other shapes may differ in a score's last bit; what is kept is scored anew, one product after the other.
    both = top.join(classes, "cid").join(queries.select("qid", F.col("v").alias("q")), "qid")
    score = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    named = both.select("qid", score.alias("score"), F.explode("ids").alias("vec_id"))
    listed = named.groupBy("qid").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("near")
    )
    of = asked.join(queries, "v").select(F.col("vec_id").alias("query_id"), "qid")
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return (
        of.join(listed, "qid")
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("rank", "x"))
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
    )


def _width(classes: DataFrame, queries: DataFrame, fit: Curves, keys: np.ndarray, k: int, aim: float, n: int) -> float:
    """The share of an ordering that a range must hold so that the windows hold ``aim`` of the true neighbours."""
    asked = queries.collect()
    if not asked:
        return 1.0
    q = np.array([r.v for r in sorted(asked, key=lambda r: r.qid)], float)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("cid").to_numpy()
            scores = q @ _matrix(batch.column("v")).T
            picks = list(_best(scores, ids, k + 1))
            at = np.concatenate([a for _, a in picks])
            yield pa.record_batch(
                [
                    pa.array(np.repeat([i for i, _ in picks], [len(a) for _, a in picks]).astype(np.int32)),
                    pa.array(np.concatenate([scores[i, a] for i, a in picks])),
                    batch.column("v").take(pa.array(at)),
                ],
                ["q", "score", "v"],
            )

    each = Window.partitionBy("q").orderBy(F.desc("score"))
    true = (
        classes.select("cid", "v")
        .mapInArrow(nearest, "q int, score double, v array<double>")
        .withColumn("n", F.row_number().over(each))
        .filter(F.col("n") <= k + 1)
        .collect()
    )
    of_query = fit.keys(_aim(q, fit.norm))
    of_found = fit.keys(_lift(np.array([r.v for r in true], float), fit.norm))
    rank = lambda got: np.stack(
        [np.searchsorted(keys[:, c], got[:, c]) / len(keys) for c in range(keys.shape[1])], axis=1
    )
    apart = np.abs(rank(of_query)[[r.q for r in true]] - rank(of_found)).min(axis=1)
    return max(float(np.quantile(apart, aim)), 1 / max(n, 1))
