"""The ``opN_<name>`` queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, periodic_runs, pii, quality, sentencepiece_codec, token_alignment, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.CONTRACT_RULES).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = sentencepiece_codec.read_model(spark, token_counts.ranks_path())
    return token_counts.count_documents(table(spark, sf_dir, "documents"), ranks)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.read_model(spark, sentencepiece_codec.tokenizer_path())
    return sentencepiece_codec.round_trips(table(spark, sf_dir, "documents"), model)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (sentencepiece_codec.read_model(spark, sentencepiece_codec.tokenizer_path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.digests(table(spark, sf_dir, "documents"), a, b)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = sentencepiece_codec.read_model(spark, token_counts.ranks_path())
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": url_filter.oracle()}
