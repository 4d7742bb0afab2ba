"""The registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodestone.llm import decontamination, divergence, dominance, language_id, licences, mixing, ngram_join, oracles, perplexity, pseudonyms, quality_classifier, repeats, token_shards, toxicity

VOCABULARY = "word_bpe_49k.json"
KEY = b"lodestone example key"  # of the query op10 only: pseudonyms that are to protect need a secret one
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The place of the public vocabulary file; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.export(table(spark, sf_dir, "documents"), vocabulary())


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), KEY)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_dominance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.dominated(table(spark, sf_dir, "sales"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_out(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_perplexity_rules,
        op3_language_id,
        op4_license_scan,
        op5_toxicity,
        op6_decontamination,
        op7_mixing,
        op8_ngram_jaccard_join,
        op9_token_shards,
        op10_pseudonyms,
        op11_source_divergence,
        op12_dominance_counts,
        op13_repeated_passages,
        pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op4_license_scan": oracles.licences(),
    "op6_decontamination": oracles.DECONTAMINATION,
    "op7_mixing": oracles.MIXING,
    "op8_ngram_jaccard_join": oracles.JOIN,
    "op11_source_divergence": oracles.DIVERGENCE,
    "op12_dominance_counts": oracles.DOMINANCE,
}
