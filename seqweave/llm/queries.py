"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, crf, histogram_sort, host_rules, length_buckets, ogg, oracles, pseudonyms, relative_lz, simhash, suffix_sort


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir), count="n_private")


def op2_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.duplicate_spans(documents(spark, sf_dir))


def op3_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(documents(spark, sf_dir))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(documents(spark, sf_dir))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.histogram_sort(documents(spark, sf_dir))


def op6_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sort.duplicate_spans(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return crf.label(docs, crf.fit(docs))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.length_buckets(documents(spark, sf_dir))


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_streams(ogg.text_media(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pseudonyms, op2_relative_lz, op3_bpe_replay, op4_host_rules, op5_histogram_sort, op6_suffix_sort, op7_simhash, op8_language_crf, op9_length_buckets, op10_ogg)
}
ORACLES: dict[str, str] = {"op2_relative_lz": oracles.DUPLICATE_SPANS, "op4_host_rules": oracles.HOST_RULES, "op6_suffix_sort": oracles.DUPLICATE_SPANS, "op7_simhash": oracles.NEAR_DUPLICATES, "op9_length_buckets": oracles.LENGTH_BUCKETS}
