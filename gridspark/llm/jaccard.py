"""Links between texts whose sets of word shingles are similar, beyond those that a few bits of a fingerprint show.

A pair of texts with a Jaccard similarity just above 0.8 differs in about ten of 64 bits of its fingerprints, so the anchors of
``simhash`` connect the closest copies only. Here the texts that are left, one for each fingerprint, meet in bands of minimum hashes: with 28 bands
of 7 hashes a pair of similarity 0.8 meets in fewer than two with a probability of 0.012, more similar ones hardly ever. In a band,
members are first compared with one leader, chosen by a hash, and those of bands that are not connected then with another; so large groups are connected by few pairs. What is still
open is dealt out in blocks, in which all signatures are compared with all: a block tells the pairs that have a chance and no others, each in the first band it meets in. A pair with a chance is compared by
its whole sets. What is shuffled is one signature, or one set, for each pair and each leader or block, and never a pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, keep_heads, text_bytes
from gridspark.llm.components import connected_components
from gridspark.llm.simhash import fingerprint, links

#: Least similarity as a fraction, so that it is compared in whole numbers.
SIMILAR = (4, 5)
BANDS, BAND_ROWS = 28, 7
#: Bands in which a pair has to meet, and the share of minimum hashes that must be equal: two deviations below 0.8.
LEAST_BANDS, LEAST_EQUAL = 2, 0.74
#: Rounds with one leader a band, and the members of a band in one part of a block, about.
LEADER_ROUNDS, BLOCK_ROWS = 2, 1024
#: Rows that stand for one leader where its pairs are compared.
SALTS = 8

_SIZE = BANDS * BAND_ROWS
_XOR, _ODD = np.random.default_rng(42).integers(0, 1 << 63, (2, _SIZE), dtype=np.uint64)
_ODD |= np.uint64(1)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = (starts + sizes)[min(width, len(words)) - 1 :]
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n))


def signature(found: np.ndarray) -> bytes:
    """The upper half of the least of every hash function over a set."""
    least = np.full(_SIZE, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), 1024):
        mixed = (found[None, lo : lo + 1024] ^ _XOR[:, None]) * _ODD[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _maybe(a: bytes, b: bytes) -> bool:
    return np.count_nonzero(np.frombuffer(a, "<u4") == np.frombuffer(b, "<u4")) >= LEAST_EQUAL * _SIZE


def _equal_enough(a: bytes, b: bytes) -> bool:
    return similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, hash, fp, n, sig) of every row: hash of the text, fingerprint, size of its set and signature."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t.as_py() for t in part.column("t")]
                sets = [shingles(t, width) for t in texts]
                prints = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
                columns = [pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary())]
                yield pa.record_batch([part.column("doc_id"), part.column("hash"), *columns], ["doc_id", "hash", "fp", "n", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), text_bytes().alias("t"))
    return rows.mapInArrow(encode, "doc_id long, hash long, fp long, n long, sig binary")


def compared(pairs: DataFrame, values: DataFrame, value: str, holds) -> DataFrame:
    """The pairs (u, v) of which ``holds`` says so, from (fp, ``value``): a leader u's value lies before those of its v in the same task."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, mine = None, b""
        for batch in batches:
            u, v, x = (batch.column(c).to_pylist() for c in ("u", "v", "x"))
            found: list[tuple[int, int]] = []
            for a, b, own in zip(u, v, x, strict=True):
                if b is None:
                    leader, mine = a, own
                elif a == leader and holds(mine, own):
                    found.append((a, b))
            yield pa.record_batch([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    own = values.select(F.col("fp").alias("_f"), F.col(value).alias("x"))
    members = pairs.join(own, F.col("v") == F.col("_f")).select("u", "v", "x", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"))
    heads = pairs.select("u").distinct().join(own, F.col("u") == F.col("_f"))
    heads = heads.select("u", F.lit(None).cast("long").alias("v"), "x", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    every = heads.unionByName(members).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return every.select("u", "v", "x").mapInArrow(check, "u long, v long")


def _chances(rows: pd.DataFrame, band: int, same: bool) -> pd.DataFrame:
    """Pairs (u, v) of a block's rows (fp, n, label, part, sig) that may be similar and meet in LEAST_BANDS bands, ``band`` the first of them.

    ``same``: the rows are one part, and all pairs are looked at; else two parts, and pairs between them.
    """
    sigs = np.frombuffer(b"".join(rows["sig"]), "<u4").reshape(len(rows), _SIZE)
    fp, n, label, part = (rows[c].to_numpy() for c in ("fp", "n", "label", "part"))
    found = []
    for lo in range(0, len(rows), 64):
        equal = (sigs[lo : lo + 64, None, :] == sigs[None, :, :]).sum(axis=2)
        here = slice(lo, lo + 64)
        fits = SIMILAR[1] * np.minimum(n[here, None], n[None, :]) >= SIMILAR[0] * np.maximum(n[here, None], n[None, :])
        good = (equal >= LEAST_EQUAL * _SIZE) & (label[here, None] != label[None, :]) & fits
        good &= fp[here, None] < fp[None, :] if same else part[here, None] < part[None, :]
        i, j = np.nonzero(good)
        met = (sigs[i + lo] == sigs[j]).reshape(-1, BANDS, BAND_ROWS).all(axis=2)
        own = (met.sum(axis=1) >= LEAST_BANDS) & (met.argmax(axis=1) == band)
        found.append(np.stack([fp[i[own] + lo], fp[j[own]]], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"u": pairs.min(axis=1), "v": pairs.max(axis=1)}) if len(pairs) else pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})


def block_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): of the members (band, key, m, fp, n, label) of open bands all pairs that have a chance, each once. A band of m members is cut into parts, and each two of them make a block."""
    parts = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    own = members.join(classes.select("fp", "sig"), "fp").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")})
    group = ["band", "key", "a", "b"]

    def look(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _chances(rows, key[0], key[2] == key[3])

    return each.select(*group, "fp", "n", "label", "part", "sig").groupBy(*group).applyInPandas(look, "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, shingles) for (fp, hash): the sets of the texts with these hashes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("fp"), pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column("t")], pa.binary())], ["fp", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("hash"), text_bytes().alias("t")).join(wanted, "hash").dropDuplicates(["fp"])
    return texts.select("fp", "t").mapInArrow(encode, "fp long, shingles binary")


def similar_links(classes: DataFrame, near: DataFrame, docs: DataFrame, scratch: Scratch, width: int = 5) -> DataFrame:
    """(node, label) of the fingerprints that ``near`` (u, v) and similar pairs of (fp, hash, n, sig) connect."""
    bucket = ["band", "key"]
    each = classes.filter("n > 0").select("fp", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring("sig", i * 4 * BAND_ROWS + 1, F.lit(4 * BAND_ROWS)))
    )).alias("band", "key"))
    shared = each.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = scratch.write(each.join(shared, bucket), "met")
    edges = near
    labels = connected_components(edges, scratch)
    for turn in range(LEADER_ROUNDS + 1):
        marked = met.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        open_ = marked.groupBy(*bucket).agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
        marked = scratch.write(marked.join(open_.select(*bucket), bucket), "open")
        if marked.isEmpty():
            break
        if turn < LEADER_ROUNDS:
            rank = F.struct(F.xxhash64("fp", F.lit(turn)), F.col("fp").alias("u"), F.col("n").alias("n_u"), F.col("label").alias("l_u"))
            lead = marked.groupBy(*bucket).agg(F.min(rank).alias("x")).select(*bucket, "x.u", "x.n_u", "x.l_u")
            pairs = marked.select(*bucket, F.col("fp").alias("v"), F.col("n").alias("n_v"), F.col("label").alias("l_v")).join(lead, bucket)
            fits = SIMILAR[1] * F.least("n_u", "n_v") >= SIMILAR[0] * F.greatest("n_u", "n_v")
            pairs = pairs.filter((F.col("l_u") != F.col("l_v")) & fits).select("u", "v").distinct()
            hopeful = scratch.write(compared(pairs, classes, "sig", _maybe), "hopeful")
        else:
            hopeful = scratch.write(block_pairs(marked, classes), "hopeful")
        wanted = hopeful.select(F.col("u").alias("fp")).distinct().union(hopeful.select("v").distinct()).distinct().join(classes.select("fp", "hash"), "fp")
        sets = scratch.write(_sets(docs, wanted, width), "sets")
        new = scratch.write(compared(hopeful, sets, "shingles", _equal_enough), "links")
        for done in (marked, hopeful, sets):
            scratch.drop(done)
        edges = edges.union(new)
        labels = connected_components(edges, scratch)
        scratch.release()
    return labels


def deduplicate(docs: DataFrame, width: int = 5, threshold: int = 4) -> DataFrame:
    """``docs`` with one row left of each group that fingerprints within ``threshold`` bits, or sets of shingles with a similarity of 0.8 or more, connect.

    The smallest doc_id stays, null last; then the text hash and the other columns decide. Texts without a word are one group. Rows are judged by their own texts:
    a null doc_id that nothing resembles stays, and so do different texts under one doc_id.
    """
    scratch, anchors = Scratch(docs.sparkSession, "jaccard"), Scratch(docs.sparkSession, "anchors")
    every = scratch.write(signed(docs, width), "signed")
    classes = scratch.write(every.groupBy("fp").agg(F.min_by(F.struct("hash", "n", "sig"), "hash").alias("x")).select("fp", "x.*"), "classes")
    rows = scratch.write(every.select("doc_id", "hash", "fp"), "rows")
    scratch.drop(every)
    near = scratch.write(links(classes.select("fp"), anchors, threshold), "near")
    anchors.clear()
    scratch.release()
    labels = similar_links(classes, near, docs, scratch, width).withColumnRenamed("node", "fp")
    labelled = rows.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return keep_heads(docs, labelled)
