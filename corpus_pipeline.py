"""Documents to packed training batches: quality rules, near-dedup, secrets, mixing, packing.

Every stage works on all that the stage before kept, and its decisions take effect in what it returns; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import jaccard, mixing, packing, quality, secret_scan
from gridspark.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the trees reject go."""
    return quality.select_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group, the one with the smallest id.

    Groups are what fingerprints of five-word shingles connect within four of 64 bits at the anchors of the covering code, and what sets of these shingles
    with a similarity of 0.8 or more connect among the rest.
    """
    return jaccard.deduplicate(docs, width=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced by a mark; no document goes."""
    return secret_scan.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the balanced mix takes it."""
    return mixing.materialise(docs)


def packing_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of whole documents in length buckets and batches."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secrets),
    ("mixing_sources", mixing_sources),
    ("packing", packing_batches),
]

#: Trees, fingerprints and dynamic programming are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
