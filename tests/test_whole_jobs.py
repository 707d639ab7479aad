"""Queries over whole tables and texts, against plain versions."""

import hashlib

import duckdb
import numpy as np

from lodestone.operators import retrieval as R
from lodestone.plans import catalogue, common
from lodestone.plans.common import table
from reference_search import bm25, terms

SF = "/root/testdata/sf0.001"


def test_every_fiftieth_vector_is_a_query(spark):
    want = {r.vec_id for r in table(spark, SF, "embeddings").collect() if r.vec_id % 50 == 0}
    got = catalogue.QUERIES["dense_cosine_topk"](spark, SF).collect()
    assert {r.query_id for r in got} == want and len(got) == 10 * len(want)
    users = {r.user_id for r in table(spark, SF, "events").select("user_id").distinct().collect()}
    assert {r.user_id for r in catalogue.QUERIES["detail_order"](spark, SF).collect()} == users


def test_nearest_in_blocks_equal_brute_force(spark):
    x = np.random.default_rng(5).integers(-2, 3, (90, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    asked = rows.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in R.dense(rows, asked, 7, block=4).collect()}
    norm, want = np.maximum(np.sqrt((x * x).sum(1)), 1e-150), {}
    for q in range(0, 90, 3):
        score = np.round(x @ x[q] / (norm * norm[q]), 6)
        for n, i in enumerate(sorted(range(90), key=lambda i: (-score[i], i))[:7]):
            want[q, n + 1] = i, score[i]
    assert got == want


def test_questions_are_whole_passages(spark):
    passages = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    assert {r.query_id: r.question for r in common.questions(spark, SF).collect()} == passages
    corpus = {r.chunk_id: r.content for r in R.active(common.chunks(spark, SF)).collect()}
    got = catalogue.QUERIES["bm25_topk"](spark, SF).where("query_id < 5").collect()
    for q in range(5):
        score = bm25(corpus, passages[q])
        assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == sorted(score, key=lambda c: (-round(score[c], 9), c))[:5]


def test_metrics_require_the_whole_passage(spark):
    # a passage whose beginning alone is found has recall below one
    text = " ".join(f"w{i}" for i in range(20))
    sql = catalogue.ORACLE_SQL["recall_at_k"]
    con = duckdb.connect()
    con.execute(f"create table benchmark as select 1 as item_id, '{text}' as text")
    con.execute(f"create table documents as select 1 as doc_id, 'src1' as source, '{' '.join(text.split()[:8])}' as text, 'en' as lang")
    assert con.execute(sql).df()["recall_at_10"].tolist() == [0.4]


def test_duplicates_have_equal_whole_texts(spark, tmp_path):
    rows = [(1, "a", "x\none"), (2, "a", "x\ntwo"), (3, "a", " x\none "), (4, "b", "x\none")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in catalogue.QUERIES["duplicate_marker_rows"](spark, str(tmp_path)).collect()] == [("a", 3)]


def embedding(text):
    out = np.zeros(384)
    for t in terms(text):
        d = hashlib.blake2b(t.encode(), digest_size=8).digest()
        out[int.from_bytes(d[:4], "little") % 384] += 1 if d[4] & 1 else -1
    return out / (np.sqrt((out * out).sum()) or 1)


def nearest(spark, k):
    """The k nearest chunks of each passage by embeddings of 384 dimensions."""
    corpus = [(r.chunk_id, embedding(r.content)) for r in R.active(common.chunks(spark, SF)).collect()]
    out = {}
    for q in table(spark, SF, "benchmark").collect():
        v = embedding(q.text)
        out[q.item_id] = sorted((-round(float(v @ x), 6), c) for c, x in corpus)[:k]
    return out


def test_embeddings_have_384_dimensions(spark):
    got = catalogue.QUERIES["hash_embedding_topk"](spark, SF).collect()
    want = {(q, c): -s for q, hits in nearest(spark, 3).items() for s, c in hits}
    assert {(r.query_id, r.chunk_id) for r in got} == want.keys()
    assert all(abs(r.score - want[r.query_id, r.chunk_id]) < 2e-6 for r in got)


def test_fusion_of_embeddings_and_whole_texts(spark):
    corpus = {r.chunk_id: r.content for r in R.active(common.chunks(spark, SF)).collect()}
    passages = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    dense = nearest(spark, 30)
    got = catalogue.QUERIES["hybrid_search"](spark, SF).collect()
    for q in sorted(passages)[:4]:
        score = bm25(corpus, passages[q])
        lexical = sorted(score, key=lambda c: (-round(score[c], 9), c))[:30]
        a, b = {c: n for n, (_, c) in enumerate(dense[q], 1)}, {c: n for n, c in enumerate(lexical, 1)}
        far = 1 << 30
        fused = {c: round(((1 / (60 + a[c]) if c in a else 0) + (1 / (60 + b[c]) if c in b else 0)) * 61 / 2, 9) for c in a.keys() | b.keys()}
        want = sorted(fused, key=lambda c: (-fused[c], a.get(c, far), b.get(c, far), c))[:10]
        assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
