"""The registered queries of this package, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firmweave.llm import (
    centroids,
    chat,
    compression,
    decontamination,
    jaccard,
    licences,
    merkle,
    mixing,
    quality,
    secrets,
    token_counts,
    toxicity,
    warc,
)
from firmweave.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


@query
def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


@query
def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality_rules(read(spark, sf_dir, "documents"))


@query
def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), least=None
    )


@query
def op5_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(
        read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query
def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op8_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(read(spark, sf_dir, "pages"))


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, sf_dir, "documents"))


@query
def op11_centroid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents")).drop("lang", "path")


@query
def op13_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    planted = spark.createDataFrame(
        [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)],
        "conv_id long, turn long, role string, text string",
    )
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    made = chat.format_conversations(
        given.unionByName(planted), public_tokenizers.path("word_bpe_49k.json")
    )
    return chat.read_back(made)
