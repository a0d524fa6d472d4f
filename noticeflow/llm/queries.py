"""Queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticeflow.llm import bpe, chat, decontam, html, importance, jaccard, periodic, phrases, pii, quality, shards, suffix, toxicity
from noticeflow.llm.common import documents


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.digest(bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.digest(pii.find(docs, pii.fit(docs), ["doc_id"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring conversations, one row per turn of a prompt or a completion."""
    return chat.format_pairs(chat.neighbours(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(documents(spark, sf_dir), shards=40)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir), size=4, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and benchmark item; clean documents have none."""
    return decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.dedup(documents(spark, sf_dir)))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html.extract(pages, html.fit(pages))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(phrases.dedup(documents(spark, sf_dir)))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the word distribution of the benchmark."""
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.collapse(periodic.planted(documents(spark, sf_dir))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_sharding": op5_sharding,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op4_chat_formatting": chat.ORACLE}
