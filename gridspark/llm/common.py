"""What several operators share: scratch tables, hashes of text and ranks without a hot window."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: For bytes.translate: A-Z lower-cased, and all of ASCII but letters and digits as a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def one_thread() -> None:
    """Call before the tokenizers library is first used: its own threads, one for each core of the machine, would wait on each other in every task."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a session on one machine (tests) gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor. They go when the driver ends in good order."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._next = 0
        folder, files = self._folder(self.root)
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def _folder(self, path: str):
        """The path and its file system, for Spark's own file access."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, label: str) -> str:
        self._next += 1
        return f"{self.root}/{self._next:03d}-{label}"

    def write(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        path = self.path(label)
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete all tables of this folder, which nothing will read again."""
        folder, files = self._folder(self.root)
        files.delete(folder, True)

    def release(self) -> None:
        """Let go of the shuffle files of jobs that are over: Spark deletes them when the driver collects its garbage, which it may not do for long."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this folder that nothing will read again."""
        for file in df.inputFiles()[:1]:
            if file.startswith(self.root) or self.root.split("://")[-1] in file:
                folder, files = self._folder(file.rsplit("/", 1)[0])
                files.delete(folder, True)


def text_bytes(column: str = "text") -> Column:
    """Whole text as UTF-8 bytes, null as empty."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def rank_in_groups(df: DataFrame, keys: list[str], order: list[str], shards: int, out: str) -> DataFrame:
    """Dense positions 0, 1, 2 … within each group, the rows in hash order.

    A group is first split into ``shards`` by a hash of ``order``; counts of shards give each its first
    position, so that no task sorts a whole group. Equal rows get different positions.
    """
    sharded = df.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(max(1, shards))).cast("int"))
    counts = sharded.groupBy(*keys, "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_shard").alias("_k_shard"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    #: Else the join would take over the window's partitions, one a group.
    starts = starts.repartition(*[f"_k_{k}" for k in keys], "_k_shard")
    own = Window.partitionBy(*keys, "_shard").orderBy(*order)
    on = F.col("_shard") == F.col("_k_shard")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ranked = sharded.withColumn("_own", F.row_number().over(own) - 1).join(starts, on, "left")
    return ranked.withColumn(out, (F.col("_before") + F.col("_own")).cast("long")).drop(
        "_shard", "_own", "_before", "_k_shard", *[f"_k_{k}" for k in keys]
    )


def about(rows: int, of: int, *columns: str) -> Column:
    """Holds for about ``rows`` rows out of ``of``, chosen by a hash of ``columns``; for all, if there are no more. Nothing is sorted."""
    if of <= rows:
        return F.lit(True)
    return F.xxhash64(*columns) < F.lit(-(1 << 63) + (1 << 64) * rows // of)


def as_struct(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one struct ``d``, so that no name of theirs can clash with one of an operator's."""
    return docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("d"))


def quoted(name: str, of: str | None = None) -> Column:
    """A column by its name, whatever characters that holds; ``of``: a field of that struct."""
    return F.col((f"{of}." if of else "") + "`" + name.replace("`", "``") + "`")


def from_struct(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the struct ``d`` again, some of them ``changed``."""
    return rows.select(*[(changed[c] if c in changed else quoted(c, "d")).alias(c) for c in columns])


def keep_heads(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``docs`` with one row left of each label; ``labelled`` holds (doc_id, hash of the text, label) of every row.

    The smallest doc_id stays, null last; then the smallest hash. Of rows equal in both, the other columns decide, as JSON.
    """
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("h_id"), F.col("hash").alias("h_hash")))
    heads = labelled.groupBy("label").agg(head.alias("x")).select("x.h_id", "x.h_hash")
    rows = as_struct(docs).select(
        "d", F.col("d.doc_id").cast("long").alias("id"), F.xxhash64("d.text").alias("hash")
    )
    rest = [quoted(c, "d") for c in docs.columns if c not in ("doc_id", "text")]
    one = Window.partitionBy("id", "hash").orderBy(F.to_json(F.struct(*rest)) if rest else F.col("hash"))
    kept = (
        rows.join(heads, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("hash") == F.col("h_hash")), "left_semi")
        .withColumn("row", F.row_number().over(one))
        .filter("row = 1")
    )
    return from_struct(kept, docs.columns)
