"""The queries of this subpackage, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import (
    alignment,
    curve_search,
    html_extract,
    mixing,
    oracles,
    packing,
    quality,
    resampling,
    secret_scan,
    simhash,
    suffix_dedup,
    token_orc,
    toxicity,
    url_filter,
)
from gridspark.llm.common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "tokens").path("orc")
    return token_orc.encode_to_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))


def op4_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans"
    )


def op5_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", "trust", "distrust"
    )


def op6_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_search.search(table(spark, sf_dir, "embeddings"))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "rate", "steps", "residual"
    )


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op10_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op11_suffix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_factor_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_stripe_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *files)


QUERIES: dict[str, Query] = {
    "op1_suffix_intervals": op1_suffix_intervals,
    "op2_length_buckets": op2_length_buckets,
    "op3_token_orc": op3_token_orc,
    "op4_linked_secrets": op4_linked_secrets,
    "op5_link_trust": op5_link_trust,
    "op6_cut_text": op6_cut_text,
    "op7_hilbert_neighbours": op7_hilbert_neighbours,
    "op8_entropy_mix": op8_entropy_mix,
    "op9_quality_trees": op9_quality_trees,
    "op10_simhash_anchors": op10_simhash_anchors,
    "op11_suffix_resampling": op11_suffix_resampling,
    "op12_factor_toxicity": op12_factor_toxicity,
    "op13_stripe_alignment": op13_stripe_alignment,
}

ORACLES: dict[str, str] = {
    "op1_suffix_intervals": oracles.SUFFIX,
    "op4_linked_secrets": oracles.SECRETS,
    "op11_suffix_resampling": oracles.RESAMPLING,
}
