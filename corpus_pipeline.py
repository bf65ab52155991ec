"""From raw documents to packed batches; each stage's result is written and read again as the next one's input.

A document without doc_id goes through the stages like any other; what each stage does with nulls, empty and
repeated rows is told by the operator that it calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqweave.llm import common, crf, length_buckets, pseudonyms, relative_lz, simhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model accepts; ``lang`` becomes what it found."""
    return crf.accepted(docs, crf.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id, those without one last."""
    return simhash.remove_near_duplicates(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds."""
    return relative_lz.remove_duplicates(docs)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, under the key that the session names."""
    return pseudonyms.pseudonymise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every document."""
    return length_buckets.length_buckets(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("private data", hide_private),
    ("packing", pack),
]

#: SQL can't express the language model, so the stages are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every result but the last is written to the shared folder.

    A stage's intermediate tables and its input go as soon as its result is written; those that the last one reads stay
    until the caller removes them by ``common.discard_since``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = common.written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, name.replace(" ", "-"))
            common.discard_since(spark, before, keep=[docs])
    return docs
