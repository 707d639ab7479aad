"""The pipeline against its operators run one by one, and on odd tables."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SCHEMA
from lodestone.llm import language_id, mixing, packing, quality_rules, simhash
from lodestone.llm.queries import ORACLE_SQL, QUERIES


def run(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    return docs


def test_stages(spark, documents, corpus):
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == documents.columns, name
        seen.append([r.doc_id for r in docs.collect()])
    assert not {1000, 1001, 1002, 1006} & set(seen[0])
    assert not set(range(120, 135)) & set(seen[1])
    assert len(seen[2]) == len(set(seen[2])) and 135 in seen[2] and 137 not in seen[2]
    assert set(seen[3]) <= set(seen[2])
    groups = [r.component_id for r in simhash.simhash_components(documents.where("doc_id >= 0 AND doc_id < 150")).collect()]
    assert len(set(groups) - set(range(120, 135))) >= len(seen[2]) - 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    whole = packing.encoded(docs, packing.tokenizer_path(), 1).selectExpr("sum(n)").first()[0]
    assert sum(len(np.frombuffer(bytes(r.ids), "<u4")) for r in pieces) == whole


def test_pipeline_of_nothing(spark, empty, clashing):
    assert run(spark, empty).count() == 0
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == clashing.columns, name


@pytest.mark.parametrize("case", [str.lower, str.title, str.upper])
def test_columns_of_any_name_come_through(spark, corpus, case):
    """Names that operators use, in any case, and names of their inner columns: values stay, none crashes."""
    names = [case(n) for n in ("rate", "copy", "mix_key", "kept", "score", "lang_pred", "rejected", "n_words", "base_failed", "component_id")] + ["_llm_fp", "_llm_source", "_llm_lang", "_llm_high_symbols", "whole"]
    docs = spark.createDataFrame(corpus[:60] + corpus[140:], SCHEMA).select("*", *(F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names), name


def test_run_equals_its_operators(spark, corpus, edge, tmp_path):
    """run over a table on disk: the same pieces as the operators one by one, each from what the one before kept."""
    spark.createDataFrame(corpus + edge, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for step in (language_id.keep_known, quality_rules.keep_good, simhash.one_of_each, mixing.mixed):
        docs = spark.createDataFrame(step(docs).collect(), docs.schema).repartition(2)
    want, got = tokens(packing.pack(docs)), tokens(corpus_pipeline.run(spark, str(tmp_path)))
    assert got == want and len({k[0] for k in got}) > 50


def tokens(pieces):
    """How often each document's each token is in a piece, however documents were cut."""
    return Counter((r.doc_id, r.start + i, int(x)) for r in pieces.collect() for i, x in enumerate(np.frombuffer(bytes(r.ids), "<u4")))


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLE_SQL) <= set(QUERIES)
