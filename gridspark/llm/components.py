"""Connected components by alternating large-star and small-star rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch

MAX_ROUNDS = 60
#: Edges for which a round has a task, four tasks at least; small tables would else be dealt to as many tasks as large ones.
EDGES_A_TASK = 100_000


def _minimum(edges: DataFrame, both: bool, tasks: int) -> DataFrame:
    """Point the neighbours of each node at the smallest of them.

    ``both``: large-star (larger neighbours move); else small-star (the node and its smaller neighbours move).
    """
    if both:
        seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    joined = seen.join(least.withColumn("m", F.least("u", "m")), "u")
    if both:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.filter(F.col("u") != F.col("v")).distinct().coalesce(tasks)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (u, v: long) to (node, label): the smallest node that can be reached.

    Only nodes with an edge to another node appear. Self-loops, repeated and reversed edges do no harm; nulls
    are dropped. Each round is written to the shared folder, so lineage stays short; a hub of any degree only
    takes part in aggregations and joins that adaptive execution can split.
    """
    clean = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    state = scratch.write(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, tasks = None, max(4, state.count() // EDGES_A_TASK)  # coalesce never makes more than the shuffle has
    for _ in range(MAX_ROUNDS):
        seen = Observation()
        sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        after = scratch.write(_minimum(_minimum(state, True, tasks), False, tasks).observe(seen, *sums), "star")
        mark = seen.get
        scratch.drop(state)
        state = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"no fixed point within {MAX_ROUNDS} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
