"""SimHash near-duplicates found at anchor points of a covering code.

A fingerprint's 64 bits are cut into three parts of 21, 21 and 22 bits. Two fingerprints that differ in at most
four bits differ in at most one bit of some part. In a part, the low 15 bits are covered by the perfect Hamming
code (radius 1) and the other bits by themselves (radius 0); the code words of both together are the anchors. Each
fingerprint has one home anchor, within the covering radius, and visits every anchor within radius plus one:
so whichever of the two is at home, the other visits. They are compared where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, keep_heads, text_bytes
from gridspark.llm.components import connected_components

#: (first bit, bits) of the three parts; the low CODE_BITS of each carry the Hamming code.
PARTS = ((0, 21), (21, 21), (42, 22))
CODE_BITS = 15
#: An anchor with more comparisons than this is split into blocks of the sizes below.
DIRECT_PAIRS = 4096
HOME_BLOCK, VISIT_BLOCK = 2048, 8192
#: Rows that stand for one component in the last join.
SALTS = 32


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z lower-cased; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    n = max(1, len(words) - width + 1)
    ends = (starts + lengths)[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    totals = np.zeros(64, np.int64)
    for lo in range(0, n, 32768):
        spans = zip(starts[lo : lo + 32768].tolist(), ends[lo : lo + 32768].tolist(), strict=False)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * totals > n)
    return sum(1 << int(b) for b in set_bits)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, hash, fp) of every row; hash is of the text, fp holds the 64 bits as a signed long."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column("t")]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("hash"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))],
                ["doc_id", "hash", "fp"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), text_bytes().alias("t")).mapInArrow(
        encode, "doc_id long, hash long, fp long"
    )


def _part(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _syndrome(v: Column) -> Column:
    """Position (1..15) of the bit that leads to the nearest Hamming code word; 0 for a code word."""
    total = F.lit(0)
    for k in range(4):
        mask = sum(1 << (p - 1) for p in range(1, CODE_BITS + 1) if p >> k & 1)
        total = total + F.bit_count(v.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << k)
    return total


def _flip(v: Column, position: Column) -> Column:
    """Flip the bit at a position of 1 or more; position 0 flips nothing."""
    return F.when(position == 0, v).otherwise(
        v.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int")))
    )


def anchors(prints: DataFrame) -> DataFrame:
    """(fp) to (fp, part, anchor, home): the home anchor and every anchor within radius plus one, in each part."""
    rows = []
    for number, (first, bits) in enumerate(PARTS):
        p = _part(F.col("fp"), first, bits)
        s = _syndrome(p.bitwiseAND(F.lit((1 << CODE_BITS) - 1)))
        rows.append(F.struct(F.lit(number).alias("part"), p.alias("p"), s.alias("s"), F.lit(bits).alias("bits")))
    parts = prints.select("fp", F.explode(F.array(*rows)).alias("x")).select("fp", "x.*")
    home = parts.withColumn("a", _flip(F.col("p"), F.col("s")))
    one = F.lit(1).cast("long")
    raw = F.transform(
        F.sequence(F.lit(CODE_BITS), F.col("bits") - 1),
        lambda b: F.col("a").bitwiseXOR(F.call_function("shiftleft", one, b.cast("int"))),
    )
    #: Code words at distance 2 flip two positions whose exclusive or is the syndrome.
    pairs = F.filter(
        F.sequence(F.lit(1), F.lit(CODE_BITS)),
        lambda q: (F.col("s") != 0) & (q != F.col("s")) & (q < q.bitwiseXOR(F.col("s"))),
    )
    near = F.transform(pairs, lambda q: _flip(_flip(F.col("p"), q), q.bitwiseXOR(F.col("s"))))
    return home.select("fp", "part", "a", F.explode(F.concat(F.array("a"), raw, near)).alias("anchor")).select(
        "fp", "part", "anchor", (F.col("anchor") == F.col("a")).alias("home")
    )


def _forest(pdf: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Edges (u, v) that connect what the close pairs of a block connect, at most one for each fingerprint."""
    homes = np.unique(pdf.fp[pdf.home].to_numpy())
    visits = np.unique(pdf.fp[~pdf.home].to_numpy())
    if not len(homes) or not len(visits):
        return pd.DataFrame({"u": np.array([], np.int64), "v": np.array([], np.int64)})
    close = np.zeros((len(homes), len(visits)), bool)
    for lo in range(0, len(homes), 128):
        differ = np.bitwise_count((homes[lo : lo + 128, None] ^ visits[None, :]).view(np.uint64))
        close[lo : lo + 128] = differ <= threshold
    top = np.iinfo(np.int64).max
    of_home = homes.copy()
    of_visit = np.full(len(visits), top)
    while True:
        of_visit = np.minimum(of_visit, np.array([of_home[c].min() if c.any() else top for c in close.T]))
        pulled = np.array([of_visit[c].min() if c.any() else top for c in close])
        new = np.minimum(of_home, pulled)
        if np.array_equal(new, of_home):
            break
        of_home = new
    reached = of_visit != top
    u = np.concatenate((homes, visits[reached]))
    v = np.concatenate((of_home, of_visit[reached]))
    return pd.DataFrame({"u": u, "v": v})[u != v]


def links(prints: DataFrame, scratch: Scratch, threshold: int = 4) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect exactly what pairs within ``threshold`` connect.

    Ordinary anchors are joined. Anchors with many comparisons are dealt out in blocks of at most HOME_BLOCK by
    VISIT_BLOCK on average; a block returns a forest and never its pairs.
    """
    if threshold > 4:
        raise ValueError("three parts with one differing bit each find pairs within 4 bits, not more")
    met = scratch.write(anchors(prints), "anchors")
    sizes = met.groupBy("part", "anchor").agg(
        F.count_if("home").alias("h"), F.count(F.lit(1)).alias("m")
    )
    sizes = scratch.write(sizes.filter((F.col("h") > 0) & (F.col("m") > 1)), "sizes")
    direct = met.join(sizes.filter(F.col("h") * F.col("m") <= DIRECT_PAIRS).select("part", "anchor"), ["part", "anchor"])
    left = direct.filter("home").select("part", "anchor", F.col("fp").alias("u"))
    right = direct.select("part", "anchor", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold
    pairs = left.join(right, ["part", "anchor"]).filter((F.col("u") < F.col("v")) & near).select("u", "v")

    hot = sizes.filter(F.col("h") * F.col("m") > DIRECT_PAIRS).select(
        "part",
        "anchor",
        F.ceil(F.col("h") / HOME_BLOCK).cast("int").alias("hs"),
        F.ceil(F.col("m") / VISIT_BLOCK).cast("int").alias("vs"),
    )
    dealt = met.join(hot, ["part", "anchor"])
    row = F.pmod(F.xxhash64("fp"), F.col("hs")).cast("int")
    column = F.pmod(F.xxhash64("fp"), F.col("vs")).cast("int")
    at_home = dealt.filter("home").select(
        "part", "anchor", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("j"), "fp", "home"
    )
    visiting = dealt.select(
        "part", "anchor", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("i"), column.alias("j"), "fp",
        F.lit(False).alias("home"),
    )
    blocks = (
        at_home.union(visiting)
        .groupBy("part", "anchor", "i", "j")
        .applyInPandas(lambda pdf: _forest(pdf, threshold), "u long, v long")
    )
    return pairs.union(blocks).distinct()


def _labelled(docs: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, hash, fp) of every row, (fp, first) of every fingerprint, and (fp, label) of those that another is linked to."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, width), "prints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = connected_components(links(classes.select("fp"), scratch, threshold), scratch)
    return rows, classes, labels.withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, width: int = 4, threshold: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id.

    A null or empty text has fingerprint 0 and is linked like any other. Rows with a null doc_id keep their row
    and take the component of their fingerprint; component_id is the smallest doc_id that is not null. Repeated
    rows return repeated rows; other columns, whatever their names, are not read. An empty table returns none.
    """
    rows, classes, labels = _labelled(docs, width, threshold)
    linked = classes.join(labels, "fp")
    heads = linked.groupBy("label").agg(F.min("first").alias("head"))
    #: A component may hold most fingerprints: its row is repeated, and its members are spread over the repetitions.
    spread = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition("label", "salt")
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    of_linked = salted.join(spread, ["label", "salt"]).select("fp", "head")
    components = classes.join(of_linked, "fp", "left").select("fp", F.coalesce("head", "first").alias("component_id"))
    return rows.join(components, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, width: int = 4, threshold: int = 4) -> DataFrame:
    """``docs`` with one row left of each group: the smallest doc_id, null last; then the text hash and the other columns decide.

    Rows are judged by their own texts: a null doc_id that nothing resembles stays, and so do different texts under one doc_id.
    """
    rows, _, labels = _labelled(docs, width, threshold)
    return keep_heads(docs, rows.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
