"""The corpus pipeline: quality rules, line dedup, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of ``documents``; the last returns a row per
piece of a training sequence.

An empty table stays empty.  Rows without an id, repeated rows and repeated ids are
handled row by row.  Columns beside ``doc_id``, ``text``, ``lang`` and ``n_chars`` are
passed on as they are, whatever their names and types.  Texts of any length are worked
on whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from junctura.llm import line_dedup, ngram_join, packing, pii, quality, storage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled thresholds reject go.

    Null and empty texts have no words and go; a null language is a stratum of its own."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in many documents stay in the last of them only.

    A null text stays null.  Rows that share an id are one document; a row without an id
    loses every such line.  ``n_chars`` is counted anew."""
    return line_dedup.deduped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows are told apart by id and text, those without an id come last, equal ones are
    one; rows without words are in no group and stay."""
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; a null text stays null.  ``n_chars`` is counted anew."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens as pieces of sequences of at most 2048; a null text gives its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

# The thresholds, the connected components and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again.

    What a stage wrote for itself, and its input, are deleted when its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = storage.mark()
    for name, stage in STAGES[:-1]:
        docs = storage.table(stage(spark, docs, sf_dir), f"stage-{name}")
        storage.release(start, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
