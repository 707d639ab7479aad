"""The engine's relations over the driver's tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import retrieval as R
from ..operators.common import shared_folder, spread

_NUMBER = "CAST(substr(source, 4) AS INT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each document; every seventh source is deleted, every third has code."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS chunk_id", "source AS source_id", "text AS content", "lang",
        f"CASE WHEN {_NUMBER} % 7 = 6 THEN 'deleted' ELSE 'completed' END AS status",
        f"CASE WHEN {_NUMBER} % 3 = 0 THEN 'code' ELSE 'docs' END AS category",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def index_of(spark: SparkSession, sf_dir: str) -> I.Index:
    """The inverted index of the active chunks: built by the first query that needs it, kept while the table's files stay the same."""
    properties = {"chunks": "active", **I.state(spark, f"{sf_dir}/documents.parquet")}
    return I.opened(spark, lambda: R.active(chunks(spark, sf_dir)), shared_folder(spark), properties, ("lang", "source_id"))


def lexical(spark: SparkSession, sf_dir: str, k: int, asked: DataFrame | None = None) -> DataFrame:
    """The k best active chunks of each question by BM25, from the index."""
    return I.search(index_of(spark, sf_dir), questions(spark, sf_dir) if asked is None else asked, k)


CHUNKS = f"""chunks AS (SELECT doc_id AS chunk_id, source AS source_id, text AS content, lang, CASE WHEN {_NUMBER} % 7 = 6 THEN 'deleted' ELSE 'completed' END AS status, CASE WHEN {_NUMBER} % 3 = 0 THEN 'code' ELSE 'docs' END AS category FROM documents)"""
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"


def tokens(text: str) -> str:
    """SQL of the terms of a text without CJK characters."""
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_.+#/-]+'), lambda t: length(t) > 1)"


def bm25(name: str, chunk_sql: str, k: int | None, prefix: str = "") -> str:
    """CTEs that end with one of that name: query_id, chunk_id, score (and rank)."""
    p = prefix
    last = f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {p}scored) WHERE rank <= {k})" if k else f"{name} AS (SELECT * FROM {p}scored)"
    return f"""{p}tok AS (SELECT chunk_id, {tokens("content")} AS tokens FROM ({chunk_sql})),
{p}corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM {p}tok),
{p}tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM {p}tok) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("question")}) AS term FROM questions) GROUP BY ALL),
{p}scored AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM {p}tf JOIN {p}df USING (term) JOIN {p}q USING (term), {p}corpus GROUP BY query_id, chunk_id),
{last}"""
