"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unpaired.llm import chat_format, collocations, decontaminate, langid, line_dedup, media, mixing, quality, ranked_search, sharding, simhash, token_counts, url_filter
from unpaired.llm.common import read


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.document_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.conversation_preferences(read(spark, sf_dir, "conversations"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_near_duplicates(read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.page_verdicts(read(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.document_languages(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mix(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.document_collocations(read(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.document_lines(read(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.benchmark_ranking(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_benchmark_decontamination, op3_token_counts, op4_chat_formatting, op5_simhash_near_dedup, op6_url_filters, op7_sharding, op8_language_id, op9_mixing, op10_quality_classifier, op11_phrase_collocations, op12_line_dedup, op13_ranked_search)}

ORACLES = {
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op4_chat_formatting": chat_format.ORACLE,
    "op6_url_filters": url_filter.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
