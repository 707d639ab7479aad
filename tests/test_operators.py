import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking as C
from lodestone.operators import evaluation as V
from lodestone.operators.quantiles import percentiles
from lodestone.operators import evidence as E
from lodestone.operators import retrieval as R
from lodestone.operators import tables as W
from reference_search import bm25


def test_bm25_equals_plain_python(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "b2", "c", "检索"]
    corpus = {i: " ".join(rng.choices(words, k=rng.randint(0, 12))) for i in range(60)}
    chunks = spark.createDataFrame(list(corpus.items()), "chunk_id int, content string")
    queries = spark.createDataFrame([(1, "alpha alpha beta"), (2, "检索 b2"), (3, "none")], "query_id int, question string")
    got = {(r.query_id, r.chunk_id): r.score for r in R.bm25(chunks, queries).collect()}
    want = {(q, k): s for q, t in ((1, "alpha alpha beta"), (2, "检索 b2"), (3, "none")) for k, s in bm25(corpus, t).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_fusion_keeps_both_scores(spark):
    a = spark.createDataFrame([(1, "A", 0.9, 1), (1, "B", 0.8, 2)], "query_id int, chunk_id string, score double, rank int")
    b = spark.createDataFrame([(1, "B", 4.0, 1), (1, "A", 2.0, 2)], "query_id int, chunk_id string, score double, rank int")
    rows = R.fuse(a, b, 5, rrf_k=10, dense_weight=1.0, lexical_weight=2.0).orderBy("rank").collect()
    assert [(r.chunk_id, r.dense_score, r.lexical_score) for r in rows] == [("B", 0.8, 4.0), ("A", 0.9, 2.0)]
    assert abs(rows[0].score - (1 / 12 + 2 / 11) / (3 / 11)) < 1e-8


def test_sections_and_hierarchy(spark):
    text = "before\n# API\nx\n\n## Retry\ny\nz"
    found = C.sections(spark.createDataFrame([("a.md", text)], "path string, text string")).orderBy("start_line").collect()
    assert [(r.locator, r.section_path) for r in found] == [("a.md#L2-L4", "API"), ("a.md#L5-L7", "API > Retry")]


def test_windows(spark):
    text = "\n".join(f"l{i}" for i in range(40))
    rows = C.windows(spark.createDataFrame([("a", text), ("e", ""), ("n", None), ("b", "\n\n")], "path string, text string")).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.reading_order) for r in rows] == [(1, 15, 0), (15, 29, 1), (29, 40, 2)]


def test_paths(spark):
    paths = {"a/.env": False, "m.safetensors": False, "node_modules/a.js": False, "k.cu": True, "K.PY": True, "x.pdf": True, "noext": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", C.admitted(F.col("p")).alias("a")).collect()
    assert {r.p: r.a for r in got} == paths


def test_changes_and_upsert(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("c", None)], "k string, h string")
    assert {r.k: r.change for r in W.changes(old, new, "k", "h").collect()} == {"a": "unchanged", "b": "update", "c": "unchanged", "d": "insert"}
    assert sorted((r.k, r.h) for r in W.upserted(old, new, "k", "h").where("h is not null").collect()) == [("a", "1"), ("b", "2"), ("d", "1")]


def test_leases(spark):
    rows = [(1, "running", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:01:00"), (3, "cancel_requested", "2024-01-01 00:00:00"), (4, "pending", None)]
    jobs = spark.createDataFrame(rows, "job_id int, status string, h string").withColumn("heartbeat_at", F.col("h").cast("timestamp"))
    out = W.recovered(jobs, F.lit("2024-01-01 00:01:10").cast("timestamp"))
    assert {r.job_id: r.status for r in out.collect()} == {1: "pending", 2: "running", 3: "cancelled", 4: "pending"}


def test_budget_cuts_the_crossing_item(spark):
    rows = [(1, n, f"S{n}", "x" * 800) for n in (1, 2, 3)]
    got = E.budgeted(spark.createDataFrame(rows, "query_id int, number int, evidence_id string, content string"), 1000).orderBy("number").collect()
    assert [r.tokens for r in got] == [200, 56] and sum(r.tokens for r in got) <= 256


def test_repair(spark):
    evidence = spark.createDataFrame([(i, "S1", "the queue retries jobs with backoff") for i in (1, 2, 3)], "run_id int, evidence_id string, content string")
    answers = spark.createDataFrame([(1, "the queue retries jobs [S1] [S9]"), (2, "no marker"), (3, "penguins fly [S1]"), (4, "x [S2]")], "run_id int, answer string")
    fallback = evidence.select("run_id", F.lit("- quoted [S1]").alias("answer"))
    got = {r.run_id: (r.action, r.answer) for r in E.repaired(answers, evidence, fallback).collect()}
    assert got == {1: ("stripped", "the queue retries jobs [S1] "), 2: ("replaced", "- quoted [S1]"), 3: ("replaced", "- quoted [S1]"), 4: ("stripped", "x ")}


def test_percentiles(spark):
    v = spark.createDataFrame([(float(x),) for x in (100, 200, 300, 400, 500)], "x double")
    shares = {"p50": 0.5, "p95": 0.95}
    assert tuple(percentiles(v, [], "x", shares).first()) == (300.0, 500.0)
    assert percentiles(v.where("x < 0"), [], "x", shares).count() == 0
    runs = v.selectExpr("'failed' AS status", "x AS latency_ms", "1 AS tokens", "2 AS tool_calls", "0 AS cache_hits")
    empty = V.run_summary(runs).first()
    assert (empty.run_count, empty.completed_count, empty.p50_latency_ms, empty.total_tool_calls) == (5, 0, None, 10)


def test_retrieval_metrics_conventions(spark):
    hits = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "Has Term here"), (3, 1, "found")], "query_id int, rank int, content string")
    need = spark.createDataFrame([(1, ["term"]), (2, ["x"]), (3, []), (4, [])], "query_id int, phrases array<string>")
    got = {r.query_id: r for r in V.retrieval_metrics(hits, need).collect()}
    assert (got[1].recall_at_1, got[1].recall_at_3, got[1].mrr) == (0.0, 1.0, 0.5)
    assert (got[2].recall_at_10, got[2].mrr, got[2].ndcg_at_10) == (0.0, 0.0, 0.0)
    assert (got[3].recall_at_5, got[4].recall_at_5, got[4].ndcg_at_10) == (0.0, 1.0, 1.0)


def test_symbols_by_line(spark):
    code = "package q\nfunc Push(x int) {\n}\n\nfunc Pop() {\n}"
    rows = C.declarations(spark.createDataFrame([("a.go", code)], "path string, text string")).orderBy("start_line").collect()
    assert [(r.name, r.start_line, r.end_line) for r in rows] == [("Push", 2, 4), ("Pop", 5, 6)]


@pytest.mark.parametrize("text, wanted", [("Table 3 things", "caption"), ("a | b", "table"), ("1 2 3 x", "table"), ("Heading", "title"), ("Heading.", "paragraph")])
def test_block_types(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(C.block_type(F.col("t"), F.lit(0), F.lit(10))).first()[0] == wanted
