"""Steps whose memory, spill or time must not grow with the table: the bounded ways against plain ones."""

import hashlib
import math
import random as random_
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import python as P
from lodestone.operators import chunking as C
from lodestone.operators import evaluation as V
from lodestone.operators import index as I
from lodestone.operators import retrieval as R
from lodestone.operators import scoring
from lodestone.plans import common, evaluation, evidence, search
from reference_search import terms

SF = "/root/testdata/sf0.001"


def test_hash_embedding_in_slices(spark, monkeypatch):
    monkeypatch.setattr(P, "TERMS", 5)
    texts = [["a", "b", "a"], [], ["c"] * 9, ["é", "x y", "b"], ["a", "q"] * 4]
    got = {r.i: r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, t array<string>").coalesce(1).select("i", P.hash_embedding(7)("t").alias("v")).collect()}
    for i, terms in enumerate(texts):
        want = [0.0] * 7
        for t in terms:
            d = hashlib.blake2b(t.encode(), digest_size=8).digest()
            want[int.from_bytes(d[:4], "little") % 7] += 1.0 if d[4] & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert got[i] == [x / norm for x in want]


def _plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_block_of_queries_needs_no_shuffle_of_vectors(spark):
    x = np.random.default_rng(6).integers(-1, 2, (300, 3)).astype(float)
    rows = spark.createDataFrame([(i * 7 % 300, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>").unionByName(spark.createDataFrame([(900, None)], "chunk_id long, vector array<double>"))
    asked = rows.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    known, met = R.dense(rows, asked, 11), R.dense(rows, asked, 11, block=4)
    assert "FlatMapCoGroups" in _plans(met) and "FlatMapCoGroups" not in _plans(known)
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, met.collect()))


def test_postings_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(i, "s", " ".join(f"w{i * j % 13}x" for j in range(9))) for i in range(150)], "chunk_id long, source_id string, content string")
    plans, written = [], type(chunks).write.fget
    monkeypatch.setattr(type(chunks), "write", property(lambda df: (plans.append(_plans(df)), written(df))[1]))
    index = I.build(chunks, f"{tmp_path}/index", block=8)
    listed = [p for p in plans if "MapInArrow" in p]
    assert listed and not any("Sort " in p for p in listed)
    rows = index.table(spark, "postings").select("term", "block", F.inline("list")).collect()
    want = {(t, i): c.split().count(t) for i, _, c in chunks.collect() for t in c.split()}
    assert {(r.term, r.chunk_id): r.tf for r in rows} == want and len(rows) == len(want)


def test_a_task_of_the_index_sorts_a_bounded_share_of_texts(spark, tmp_path, monkeypatch):
    texts = [None if i == 5 else " ".join(f"w{i * j % 13}x" for j in range(9)) for i in range(400)]
    chunks = spark.createDataFrame([(i, f"s{i % 3}", t) for i, t in enumerate(texts)], "chunk_id long, source_id string, content string").coalesce(1)
    queries = spark.createDataFrame([(1, "w3x w5x w5x"), (2, "w7x")], "query_id long, question string")
    whole = I.build(chunks, f"{tmp_path}/whole", block=8)
    monkeypatch.setattr(I, "RANGE", 2000)
    index = I.build(chunks, f"{tmp_path}/index", block=8)
    held = index.table(spark, "forward").groupBy(F.input_file_name().alias("file")).agg(F.collect_set("chunk_id").alias("ids")).collect()
    most = max(sum(len(texts[i] or "") for i in r.ids) for r in held)
    assert sum(len(r.ids) for r in held) == 400 and len(held) > 5 and most <= 2 * I.RANGE
    found = lambda x: sorted(map(tuple, I.search(x, queries, 7).collect()))
    assert found(index) == found(whole) and len(found(index)) == 14


def test_texts_of_hits_take_no_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # texts are too large for it
    try:
        for df in (evidence.token_budget(spark, SF), evaluation.recall_at_k(spark, SF)):
            assert "hashpartitioning(chunk_id" not in _plans(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_shared_bootstrap_equals_that_of_one_task(spark, monkeypatch):
    random = np.random.default_rng(3)
    groups = {"bits": random.integers(0, 2, 300) * 1.0, "wide": random.normal(size=517) * 10.0 ** random.integers(-30, 30, 517), "power": random.random(256), "same": np.full(400, 0.1), "few": random.random(20)}
    rows = [(k, float(x), i * 7919 % 10007) for k, v in groups.items() for i, x in enumerate(v)]
    values = spark.createDataFrame(rows, "k string, x double, _order long").repartition(5)
    want = {r.k: r for r in V.bootstrap(values, "k", "x", 7, 200).collect()}
    monkeypatch.setattr(V, "EXACT_DRAWS", 100 * 200)
    monkeypatch.setattr(V, "PART", 200)
    monkeypatch.setattr(V, "_shared_bootstrap", lambda *a, f=V._shared_bootstrap: called.append(1) or f(*a))
    called = []
    got = {r.k: r for r in V.bootstrap(values, "k", "x", 7, 200).collect()}
    assert called and {k: (r.low, r.high) for k, r in got.items()} == {k: (r.low, r.high) for k, r in want.items()}
    assert all(math.isclose(got[k].mean, want[k].mean, rel_tol=1e-15) for k in groups)


def test_draws_of_the_generator_from_kept_states():
    n = 300_001
    states = [b.to_pylist()[0] for b in P.generator_states(11, n, 1_500_000)]
    r = random_.Random(11)
    assert len(states) > 2 and np.concatenate([P.generator_draws(s["state"], n) for s in states])[:1_500_000].tolist() == [r.randrange(n) for _ in range(1_500_000)]


def test_compared_modes_compute_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i // 3, ("naive", "fixed_retrieval", "agentic")[i % 3], float(i % 7 % 2)) for i in range(60)], "id long, mode string, correctness double")
    got = V.compared(rows.mapInArrow(count, rows.schema), ["naive", "fixed_retrieval", "agentic"], seed=7, samples=20).collect()
    assert [r.questions for r in got] == [20, 20] and seen.value == 60


def test_embeddings_of_the_index_equal_those_of_texts(spark):
    chunks, questions = R.active(common.chunks(spark, SF)), common.questions(spark, SF).limit(20)
    got = search.indexed_embedding_hits(spark, SF)(chunks, questions, 3)
    assert "regexp_extract_all(lower(text" not in _plans(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.embedding_hits(chunks, questions, 3).collect()))


def _plain_keyword_hits(chunks, questions, k):
    out = set()
    for q, text in questions:
        wanted = set(terms(text))
        scored = sorted((-min(1.0, n / 5), i, n) for i, c in chunks if (n := sum((c or "").lower().count(t) for t in wanted)))
        out |= {(q, i, n, -s, r) for r, (s, i, n) in enumerate(scored[:k], 1)}
    return out


def test_keywords_are_counted_by_the_tasks_that_have_the_chunks(spark, monkeypatch):
    monkeypatch.setattr(scoring, "POINTS", 40)
    monkeypatch.setattr(scoring, "ENTRIES", 50)
    words = ["aa", "aaa", "aaaa", "aba", "ababa", "that", "thathat", "x", "é", "naïve", "in", "inin", "a.b-c", "字", "測試"]
    random = np.random.default_rng(9)
    texts = [" ".join(random.choice(words, random.integers(0, 9))) for _ in range(120)] + ["", None, "a" * 101, "??"]
    rows = [(i * 37 % 124, t) for i, t in enumerate(texts)]
    asked = [(1, "aa aba that"), (2, "in naïve INin"), (3, "thathat zz a.b"), (4, "?"), (5, "字 測試 aaaa"), (6, None)]
    chunks = spark.createDataFrame([(*r, "code") for r in rows], "chunk_id long, content string, category string").repartition(3)
    questions = spark.createDataFrame(asked, "query_id int, question string")
    got = R.keyword_search(chunks, questions, 5)
    # only the queries' best go on: no row for each pair of query and chunk, and no words of chunks in a join
    assert "MapInArrow" in _plans(got) and "Join" not in _plans(got)
    latin = lambda s: {r for r in s if r[0] != 5}  # noqa: E731  (the plain twin has its own CJK terms)
    assert latin(map(tuple, got.collect())) == latin(_plain_keyword_hits(rows, [(q, t or "") for q, t in asked], 5))
    monkeypatch.setattr(R, "known", lambda terms: False)
    joined = R.keyword_search(chunks, questions, 5)
    assert "MapInArrow" not in _plans(joined) and sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect()))
    monkeypatch.undo()
    assert R.keyword_search(chunks, questions.where("query_id = 4"), 5).count() == 0 == R.keyword_search(chunks.limit(0), questions, 5).count()


def _plain_merge(pages, size):
    """(doc, page, blocks of (text, x0)) merged: doc, page, number, kind, heading, section of the page, content, x0, x1."""
    out = []
    for doc, page, blocks in pages:
        groups, title = [], None
        for i, (text, x) in enumerate(blocks):
            t = (text or "").strip(" \t\n\v\f\r")
            kind = "paragraph"
            if text is None:
                pass
            elif re.match(r"(?i)(table|figure|fig\.)[ \t\n\v\f\r]*[0-9]", t):
                kind = "caption"
            elif "|" in t or sum(bool(re.search("[0-9]", w)) for w in re.split(r"[ \t\n\v\f\r]+", t)) >= 3:
                kind = "table"
            elif i < max(3, len(blocks) // 12) and len(t) < 120 and not t.endswith("."):
                kind = "title"
            last = groups[-1] if groups else None
            if last and text is not None and last["n"] is not None and last["kind"] == kind and last["n"] + len(text) <= size:
                last["n"] += len(text)
                last["texts"].append(text)
                last["x"].append(x)
            else:
                groups.append({"kind": kind, "n": None if text is None else len(text), "texts": [text], "x": [x]})
        for n, g in enumerate(groups):
            content = None if g["texts"] == [None] else "\n".join(g["texts"]).strip(" \t\n\v\f\r")
            title = content if g["kind"] == "title" else title
            out.append((doc, page, n, g["kind"], content if g["kind"] == "title" else None, title, content, min(g["x"]), max(g["x"]) + 1))
    return out


def test_pages_are_merged_without_a_shuffle(spark):
    random = np.random.default_rng(4)
    some = ["Title", "A sentence that ends.", " \t padded \x0b", "1 2", "1 2 3", "a1b2c3", "1\t2x 3\n4", "x 1 y 2 z 3", "Table 3 of it", "fig.7", "a | b", "", "9" * 40, "w" * 130, None]
    pages = [(f"d{n % 7}", n // 7, [(some[random.integers(len(some))], float(random.integers(0, 50))) for _ in range(n % 30)]) for n in range(1, 120)]
    rows = spark.createDataFrame([(d, p, [(t, x, x, x + 1, x + 1) for t, x in b]) for d, p, b in pages], "doc string, page int, b array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")
    got = C.merged_pages(rows, 60)
    assert "Exchange" not in _plans(got)
    columns = ("doc", "page", "reading_order", "block_type", "heading", "section", "content", "x0", "x1")
    held = lambda df: sorted(df.select(*columns).collect(), key=lambda r: r[:3])
    want = sorted(_plain_merge(pages, 60))
    assert [tuple(r) for r in held(got)] == want
    apart = rows.select("doc", "page", F.posexplode("b").alias("reading_order", "x")).select("doc", "page", "reading_order", "x.*").repartition(3)
    assert [tuple(r) for r in held(C.merged_blocks(apart, 60))] == want
    title, carried = {}, []
    for r in want:
        title[r[0]] = r[4] if r[3] == "title" else title.get(r[0])
        carried.append((*r[:5], title[r[0]], *r[6:]))
    assert [tuple(r) for r in held(C.merged_pages(rows, 60, carry=True))] == carried
    assert C.merged_pages(rows.where("page < 0")).count() == 0
