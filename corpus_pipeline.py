"""A training corpus from raw documents: quality rules, toxicity, SimHash near-dedup, removal of
repeated strings, packing. Each stage works on all that the one before it kept; its result is
written as Parquet and read again.

Defined results: nulls, empty and long texts, repeated rows, empty tables and further columns are
handled as each stage's operator says; all stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thali.llm import packing, quality_rules, simhash, suffix_dedup, toxicity
from thali.llm.common import table, written
from thali.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their hosts' boilerplate lines."""
    return quality_rules.clean_documents(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_per_group(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that repeat."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, dealt to sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality", quality), ("toxicity", not_toxic), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup),
          ("packing", pack)]

#: SQL cannot express the toxicity model, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, delete = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, then = written(stage(spark, docs, sf_dir))
        if delete:
            delete()
        delete = then
    return docs
