"""The queries of the operators, one opN_<name> each, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle, licenses, mixing, quality_rules


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards documents of good quality, and whether it is drawn."""
    from .resampling import good_share, resample

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(_documents(spark, sf_dir), labels.where("quality = 1"), good_share(labels))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources."""
    from .mixing import mix

    return mix(_documents(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and adaptive verdict of every document."""
    from .quality_rules import quality

    return quality(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    from .language_id import identify

    return identify(_documents(spark, sf_dir))


def op5_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improbable-feature digests of every document and of its edited text."""
    from .digests import fingerprints

    return fingerprints(_documents(spark, sf_dir)).select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences whose sources have tempered shares."""
    from .packing import pack

    return pack(_documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "target_share", "window_share")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between documents of good quality and all documents."""
    from .lm_scoring import score

    return score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to flat token files and read back."""
    from .token_files import round_trip

    return round_trip(_documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from .toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    from .simhash import simhash_components

    return simhash_components(_documents(spark, sf_dir))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.digests(_documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on up to 32 whitened components."""
    from .whitening import whitened

    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for fill-in-middle training, and rebuilt."""
    return fill_in_middle.digests(_documents(spark, sf_dir))


QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_digests": op5_digests,
    "op6_packing": op6_packing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_token_files": op8_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_licenses": op11_licenses,
    "op12_whitening": op12_whitening,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op11_licenses": licenses.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
