"""Entropy balancing: document rates that meet token targets of sources, rounded into whole copies.

Among all rates held at ``cap``, those closest to the prior in relative entropy that give each source its target, and that keep
the corpus's share of words in each class of length as far as the targets allow (a penalty on the distance, not a demand), are
the prior times ``exp(multiplier of the source + multiplier of the length class)``. The dual of this is convex; Newton's
method with step halving solves it from zero multipliers. A document's source and its length class pull at it together, so the
sources' equations are coupled: they are eliminated in Spark, and what is left is one small equation for the classes. A step
aggregates sums of words per source. Everything is a DataFrame expression. Sums are of whole or fixed-point numbers,
so reruns agree to the last copy.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import WORD, Scratch, as_struct, from_struct

#: Rates are rounded in units of 2**-RATE_BITS, so that their sums are exact.
RATE_BITS = 24
#: Documents in a rounding cell, about; larger groups of one source and size are split by a hash of doc_id.
CELL_ROWS = 500_000
#: Words at which a new class of length begins.
LENGTHS = (64, 256, 1024, 4096)
CLASSES = range(len(LENGTHS) + 1)
#: Sums of fractions of words are taken in units of 2**-40.
_FIXED = 1 << 40
#: Tables with one row a source are broadcast up to so many sources, about 10 MB.
BROADCAST_SOURCES = 100_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, size) to (source, source_size, target).

    Sources in code point order, null last, weigh 1, 2, 3, 1, … and share all words; no target exceeds ``cap``
    times its source's words, and what is cut off is shared by weight again. The sources that end up cut off are
    the first ones in order of room per weight, so one ordered pass over the sources finds them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("weight", (F.pmod(place, F.lit(3)) + 1).cast("long"))
    room = F.col("source_size") * cap
    ordered = Window.orderBy(room / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("weight").over(rest)
    shared = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= room)
    #: Behind the first source that has room left, levels only fall; so the largest is the common one.
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), room).otherwise(common * F.col("weight"))
    return shared.select("source", "source_size", "rows", F.least(target, room).cast("double").alias("target"))


@dataclass
class Balance:
    """A solution: (k, multiplier, full) of the sources, the multipliers of the length classes, and how it was found."""

    sources: DataFrame
    classes: list[float]
    steps: int
    residual: float


def length_class(size: Column) -> Column:
    return sum((F.when(size >= at, 1).otherwise(0) for at in LENGTHS), F.lit(0))


def _key(source: str = "source") -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _exact(x: Column) -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.sum((x * _FIXED).cast("decimal(38,0)")).cast("double") / _FIXED


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """A small system of equations by elimination with the largest pivot."""
    rows = [[*m, r] for m, r in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        best = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for j in range(n):
            if j != i and rows[j][i]:
                f = rows[j][i] / rows[i][i]
                rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [r[-1] / r[i] for i, r in enumerate(rows)]


def balance(
    cells: DataFrame, targets: DataFrame, scratch: Scratch, cap: float, slack: float = 0.1, tolerance: float = 1e-9, max_steps: int = 200
) -> Balance:
    """Multipliers for ``cells`` (k, prior, w0 … w4: words by length class) that meet ``targets`` (k, t).

    Minimises sum(words × phi(multipliers)) − sum(target × multiplier) + slack / 2 × sum(class words × class multiplier²), phi being the
    integral of the capped rate. A source whose target is ``cap`` times its words is full and held at the cap; one without
    words or target gets no multiplier. The residual is the worst distance of an open source's words from its
    target, relative to it; if it is above ``tolerance`` after ``max_steps`` evaluations, an error is raised.
    """
    w = [f"w{i}" for i in CLASSES]
    words = sum((F.col(c) for c in w), F.lit(0))
    per = cells.groupBy("k").agg(F.sum(words * F.col("prior")).alias("m"), F.sum(words).alias("n"))
    state = targets.join(per, "k").filter((F.col("t") > 0) & (F.col("m") > 0)).select(
        "k", "t", (F.col("t") >= cap * F.col("n")).alias("full"), F.lit(0.0).alias("a"), F.lit(0.0).alias("da")
    )
    state = scratch.write(state, "dual")
    all_words = [float(x or 0) for x in cells.agg(*[F.sum(c) for c in w]).first()]
    b, db, t = [0.0] * len(w), [0.0] * len(w), 0.0
    least = best = None
    for step in range(1, max_steps + 1):
        a_new = F.col("a") + t * F.col("da")
        b_new = [x + t * d for x, d in zip(b, db, strict=True)]
        z = [F.log("prior") + a_new + F.lit(x) for x in b_new]
        top = F.log(F.lit(cap))
        rate = [F.when(F.col("full"), cap).otherwise(F.exp(F.least(top, x))) for x in z]
        phi = [F.when(F.col("full"), 0.0).otherwise(F.exp(F.least(top, x)) + cap * F.greatest(F.lit(0.0), x - top)) for x in z]
        got = cells.filter("prior > 0").join(state, "k").groupBy("k").agg(
            F.first("t").alias("t"), F.first("full").alias("full"), F.first("a").alias("a"), F.first("da").alias("da"),
            *[_exact(F.col(c) * r).alias(f"g{i}") for i, (c, r) in enumerate(zip(w, rate, strict=True))],
            *[_exact(F.when(~F.col("full") & (x < top), F.col(c) * r).otherwise(0.0)).alias(f"c{i}") for i, (c, r, x) in enumerate(zip(w, rate, z, strict=True))],
            _exact(sum((F.col(c) * p for c, p in zip(w, phi, strict=True)), F.lit(0.0))).alias("phi"),
        )
        off = F.when(F.col("full"), 0.0).otherwise(sum((F.col(f"g{i}") for i in CLASSES), F.lit(0.0)) - F.col("t"))
        bend = sum((F.col(f"c{i}") for i in CLASSES), F.lit(0.0))
        share = lambda i: F.when(bend > 0, F.col(f"c{i}") / bend).otherwise(0.0)
        sums = got.agg(
            _exact(F.when(F.col("full"), 0.0).otherwise(F.col("phi") - a_new * F.col("t"))).alias("dual"),
            F.max(F.abs(off) / F.col("t")).alias("worst"),
            *[_exact(F.col(f"g{i}")).alias(f"g{i}") for i in CLASSES], *[_exact(share(i) * off).alias(f"r{i}") for i in CLASSES],
            *[_exact(F.col(f"c{i}")).alias(f"c{i}") for i in CLASSES],
            *[_exact(share(i) * F.col(f"c{j}")).alias(f"m{i}_{j}") for i in CLASSES for j in CLASSES if i <= j],
        ).first()
        if sums.worst is None:
            return Balance(state.select("k", F.col("a").alias("multiplier"), "full"), b, 0, 0.0)
        pull = slack / 2 * sum(n * x * x for n, x in zip(all_words, b_new, strict=True))
        dual = sums.dual + pull - sum(n * x for n, x in zip(all_words, b_new, strict=True))
        slope = [sums[f"g{i}"] - all_words[i] * (1 - slack * b_new[i]) for i in CLASSES]
        miss = max(sums.worst, *[abs(x) / n for x, n in zip(slope, all_words, strict=True) if n])
        #: Close to the solution the dual is flat, and what is missed says more.
        if least is not None and dual > least and miss >= best and t > 1e-9:
            t /= 2
            continue
        if miss <= tolerance:
            found = got.select("k", a_new.alias("multiplier"), "full")
            return Balance(scratch.write(found, "solved"), b_new, step, sums.worst)
        matrix = [[-sums[f"m{min(i, j)}_{max(i, j)}"] + (sums[f"c{i}"] + slack * all_words[i] if i == j else 0.0) for j in CLASSES] for i in CLASSES]
        for i in CLASSES:
            if not all_words[i]:
                matrix[i][i], slope[i] = 1.0, 0.0
        direction = _solve(matrix, [sums[f"r{i}"] - x for i, x in zip(CLASSES, slope, strict=True)])
        move = -(off + sum((F.col(f"c{i}") * d for i, d in zip(CLASSES, direction, strict=True)), F.lit(0.0))) / bend
        move = F.when(F.col("full"), 0.0).when(bend > 0, move).otherwise(F.when(off > 0, -1.0).otherwise(0.0))
        after = scratch.write(got.select("k", "t", "full", a_new.alias("a"), move.alias("da")), "dual")
        scratch.drop(state)
        state, b, db, least, best, t = after, b_new, direction, dual, miss, 1.0
    raise RuntimeError(f"no balance within {max_steps} evaluations: worst residual {sums.worst}")


def _rounded(rows: DataFrame, cells_of: int) -> DataFrame:
    """Whole copies: the floor of the rate, and one more for the rows at which the running sum of the fractions,
    in order of size, passes a whole number. Neighbours in this order are about as long, so words come out near."""
    unit = 1 << RATE_BITS
    split = rows.withColumn("q", F.round(F.col("rate") * unit).cast("long")).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, cells_of))).cast("int")
    )
    split = split.withColumn("part", F.pmod(F.col("q"), F.lit(unit)))
    sums = split.groupBy("k", "size", "shard").agg(F.sum("part").alias("cell"))
    before = Window.partitionBy("k").orderBy("size", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "k", "size", "shard", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("before")
    ).repartition("k", "size", "shard")
    own = Window.partitionBy("k", "size", "shard").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    run = F.col("before") + F.sum("part").over(own) + unit // 2
    placed = split.join(starts, ["k", "size", "shard"]).withColumn("run", run)
    extra = F.floor(F.col("run") / unit) - F.floor((F.col("run") - F.col("part")) / unit)
    return placed.withColumn("copies", (F.floor(F.col("q") / unit) + extra).cast("long")).select(
        "row", "doc_id", "hash", "source", "k", "size", "target", "source_size", "rate", "copies"
    )


def _nearer(rows: DataFrame, cap: float, small) -> DataFrame:
    """One copy more or less of one document of each source, where that brings its words nearer to the target."""
    due = rows.groupBy("k").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("got"))
    due = due.select("k", (F.col("t") - F.col("got")).alias("due"))
    open_ = rows.join(small(due), "k").filter(
        (F.col("size") > 0)
        & (((F.col("due") > 0) & (F.col("copies") + 1 <= cap)) | ((F.col("due") < 0) & (F.col("copies") > 0)))
    )
    pick = open_.groupBy("k").agg(
        F.min(F.struct(F.abs(F.abs("due") - F.col("size")).alias("gap"), "doc_id", "row", "due")).alias("p")
    )
    chosen = pick.filter(F.col("p.gap") < F.abs("p.due")).select(
        F.col("k").alias("c_k"), F.col("p.row").alias("c_row"), F.signum("p.due").cast("long").alias("change")
    )
    return (
        rows.join(small(chosen), (F.col("k") == F.col("c_k")) & (F.col("row") == F.col("c_row")), "left")
        .withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
        .drop("c_k", "c_row", "change")
    )


def balanced(sizes: DataFrame, targets: DataFrame, scratch: Scratch, cap: float = 3.0, slack: float = 0.1) -> Balance:
    """The balance of documents (source, size, prior) that meets the targets of ``source_targets``."""
    words = [F.sum(F.when(length_class(F.col("size")) == i, F.col("size")).otherwise(0)).alias(f"w{i}") for i in CLASSES]
    cells = sizes.filter("size > 0 and prior > 0").groupBy(_key().alias("k"), "prior").agg(*words)
    return balance(scratch.write(cells, "cells"), targets.select(_key().alias("k"), F.col("target").alias("t")), scratch, cap, slack)


def _copies(docs: DataFrame, scratch: Scratch, cap: float, corrections: int, prior: Column | None, slack: float) -> tuple[DataFrame, Balance]:
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count().alias("size"),
        (F.lit(1.0) if prior is None else prior).cast("double").alias("prior"), F.xxhash64("text").alias("hash"),
    )
    sizes = scratch.write(base, "sizes")
    targets = scratch.write(source_targets(sizes, cap), "targets")
    total, sources = targets.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    small = F.broadcast if sources <= BROADCAST_SOURCES else lambda df: df
    found = balanced(sizes, targets, scratch, cap, slack)
    known = targets.select(_key().alias("k"), "source_size", "target").join(found.sources, "k", "left")
    of_class = F.element_at(F.array(*[F.lit(x) for x in found.classes]), length_class(F.col("size")) + 1)
    tilted = F.least(F.lit(cap), F.col("prior") * F.exp(F.col("multiplier") + of_class))
    rate = F.when(F.col("full"), cap).otherwise(tilted)
    rate = F.when(F.col("multiplier").isNull() | F.coalesce(F.col("prior") <= 0, F.lit(True)), 0.0).otherwise(rate)
    rated = sizes.withColumn("k", _key()).join(small(known), "k").withColumn("rate", rate)
    rounded = scratch.write(_rounded(rated, 1 + isqrt(total // CELL_ROWS)), "copies")
    for _ in range(corrections):
        before, rounded = rounded, scratch.write(_nearer(rounded, cap, small), "copies")
        scratch.drop(before)
    return rounded, found


def mix(docs: DataFrame, cap: float = 3.0, corrections: int = 3, prior: Column | None = None, slack: float = 0.1) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken (= size × copies), steps, residual.

    ``steps`` and ``residual`` say how the balance was found. A smaller ``slack`` holds the shares of the length classes more firmly. Null
    texts have size 0; a null source is a source of its own; null doc_ids and repeated rows keep their rows, and
    of equal rows it does not matter which gets a copy more. A source without words has target 0 and no
    copies, nor have rows whose prior is null or not above 0. Other columns are not read; an empty table returns none. Copies never exceed ``cap``.
    """
    rows, found = _copies(docs, Scratch(docs.sparkSession, "mixing"), cap, corrections, prior, slack)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), F.lit(found.steps).alias("steps"), F.lit(found.residual).alias("residual"),
    )


def materialise(docs: DataFrame, cap: float = 3.0, corrections: int = 3, slack: float = 0.1) -> DataFrame:
    """``docs`` with each row repeated by its copies; rows with no copy are gone.

    The texts are shuffled once, by doc_id, source and a hash of the text; so rows of one doc_id, or of none, spread over the tasks. Rows
    that are equal in all three share out their copies in a fixed order.
    """
    keys = ["id", "source", "hash"]
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    copies, _ = _copies(docs, Scratch(docs.sparkSession, "mixing"), cap, corrections, None, slack)
    listed = copies.groupBy(doc_id.alias("id"), F.col("k").alias("source"), "hash").agg(F.array_sort(F.collect_list("copies")).alias("copies"))
    rows = as_struct(docs).select("d", F.col("d.doc_id").alias("doc_id"), F.col("d.source").alias("source"), F.xxhash64("d.text").alias("hash"))
    rows = rows.select("d", doc_id.alias("id"), _key().alias("source"), "hash")
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    joined = placed.join(listed, keys).withColumn("n", F.element_at("copies", F.col("at")))
    taken = joined.filter("n > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return from_struct(taken, docs.columns)
