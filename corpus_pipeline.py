"""Corpus pipeline: language ID, quality rules, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents.

Rows of null id take part in every stage. Texts are worked on whole, however long; memory follows the longest one. Columns of docs
beyond those of documents, also those named like an operator's own, come through all stages but the last, which has its own columns. An
empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import language_id, mixing, packing, quality_rules, shared, simhash


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises; those it rejects go.

    Null, empty and letterless texts go. Rows of null lang teach nothing but are judged like others; without any label all rows go. Repeated
    rows share their fate; a score at the threshold stays.
    """
    return language_id.keep_known(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the adaptive thresholds of their language and source.

    Null and short texts fail the base rule. Null lang and source are groups of their own. Repeated rows share their fate; a value at a fence stays.
    """
    return quality_rules.keep_good(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id, null last; of rows of one id the first as written.

    Texts without a word, null ones too, have one fingerprint and are one group. Repeated rows leave one.
    """
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, shuffled.

    Null source is the source "". Null texts are replicated like others. Repeated rows have equal counts.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in training sequences.

    Null text is empty: its end id only. Copies of a document are documents of their own. Of equal deficits the first source by name is served.
    """
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A trained classifier and a tokenizer decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
