"""Queries of tokenizing, indexing, retrieval and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.python import hash_embedding
from ..operators import index as I
from ..operators import retrieval as R
from .common import CHUNKS, QUESTIONS, bm25, chunks, index_of, lexical, questions, table, tokens

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ACTIVE = "SELECT * FROM chunks WHERE status = 'completed'"


@query(f"WITH {CHUNKS}, {QUESTIONS}, {bm25('hits', _ACTIVE, 5)} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def bm25_topk(spark, sf):
    """The five best chunks of each question by BM25."""
    hits = lexical(spark, sf, 5)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def bm25_index_work(spark, sf):
    """Of each question: the blocks that have one of its terms, those whose bound reached its fifth best score, and the chunks scored in them."""
    return I.search(index_of(spark, sf), questions(spark, sf), 5, work=True)


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, t[1] AS first_term FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)")
def tokenize_terms(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"), F.get("t", F.lit(0)).alias("first_term"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL")
def term_frequency(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.tokenize("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({tokens('text')})) AS term FROM documents) GROUP BY term")
def document_frequency(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.array_distinct(T.tokenize("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT count(*) AS n_docs, round(avg(len({tokens('text')})), 6) AS avg_length FROM documents")
def avg_doc_length(spark, sf):
    return table(spark, sf, "documents").select(F.size(T.tokenize("text")).alias("n")).agg(F.count("*").alias("n_docs"), F.round(F.avg("n"), 6).alias("avg_length"))


_CJK_ROWS = [(1, "向量检索"), (2, "使用BM25检索v2.0接口"), (3, "字"), (4, "Hello 世界 foo-bar a"), (5, "测试x试"), (6, "plain text only")]


@query("""WITH rows(id, t) AS (VALUES (1, '向量检索'), (2, '使用BM25检索v2.0接口'), (3, '字'), (4, 'Hello 世界 foo-bar a'), (5, '测试x试'), (6, 'plain text only')),
raw AS (SELECT id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}_.+#/-]+') AS w FROM rows)),
parts AS (SELECT id, i, x, regexp_extract_all(x, '[㐀-鿿]') AS c FROM raw),
terms AS (SELECT id, i, CASE WHEN len(c) > 0 THEN list_concat(list_concat(c, list_transform(range(1, len(c)), lambda k: c[k] || c[k + 1])), regexp_extract_all(x, '[a-z0-9_.+#/-]{2,}')) WHEN length(x) > 1 THEN [x] ELSE [] END AS t FROM parts)
SELECT id, array_to_string(flatten(list(t ORDER BY i)), '|') AS terms FROM terms GROUP BY id""")
def tokenize_cjk(spark, sf):
    rows = spark.createDataFrame(_CJK_ROWS, "id int, t string")
    return rows.select("id", F.array_join(T.tokenize("t"), "|").alias("terms"))


DIMENSIONS = 384


def embedded(df, key, text):
    return df.select(key, hash_embedding(DIMENSIONS)(T.tokenize(text)).alias("vector"))


def embedding_hits(chunks, questions, k):
    return R.dense(embedded(chunks, "chunk_id", "content"), embedded(questions, "query_id", "question"), k)


def indexed_embedding_hits(spark, sf):
    """embedding_hits of the active chunks from the terms that their index has: chunks are tokenized once, not in each search."""

    def hits(_, questions, k):
        terms = index_of(spark, sf).table(spark, "forward")
        return R.dense(terms.select("chunk_id", hash_embedding(DIMENSIONS)("tokens").alias("vector")), embedded(questions, "query_id", "question"), k)

    return hits


@query()
def hash_embedding_topk(spark, sf):
    """The three nearest chunks of each question by hashed embeddings of 384 dimensions."""
    return embedding_hits(R.active(chunks(spark, sf)), questions(spark, sf), 3)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


_DENSE = """q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id % 50 = 0),
v AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, label, round(list_cosine_similarity(v, q), 6) AS score FROM v, q)) WHERE rank <= 10)"""


def _dense_hits(spark, sf):
    vectors = _vectors(spark, sf)
    return R.dense(vectors, vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), 10)


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM hits")
def dense_cosine_topk(spark, sf):
    """The ten nearest vectors of every fiftieth vector: queries grow with the table."""
    return _dense_hits(spark, sf)


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM hits WHERE label <> 3")
def dense_post_filter(spark, sf):
    """Hits of inactive sources (label 3) go after the top k, so a query may have fewer."""
    return _dense_hits(spark, sf).join(_vectors(spark, sf).where("label <> 3").select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", "score", "rank")


def _channels(spark, sf, k=20):
    """Cosine over stored vectors, of which that with a question's number stands for its encoding, and BM25 over whole chunks."""
    c, q, v = R.active(chunks(spark, sf)), questions(spark, sf), _vectors(spark, sf)
    stored = v.join(c.select("chunk_id"), "chunk_id", "left_semi")
    asked = v.select(F.col("chunk_id").alias("query_id"), "vector").join(q.select("query_id"), "query_id", "left_semi")
    return R.dense(stored, asked, k), lexical(spark, sf, k)


_NEAREST = """a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT qv.vec_id AS query_id, cv.vec_id AS chunk_id, round(list_cosine_similarity(list_transform(cv.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(qv.embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score
  FROM embeddings qv JOIN questions ON query_id = qv.vec_id, embeddings cv JOIN chunks ON chunk_id = cv.vec_id AND status = 'completed')) WHERE rank <= 20)"""
_CHANNELS = f"""{CHUNKS}, {QUESTIONS}, {_NEAREST}, {bm25('b', _ACTIVE, 20, 'b_')},
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.score AS dense_score, a.rank AS dense_rank, b.score AS lexical_score, b.rank AS lexical_rank, round((coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0)) / (CAST(2 AS DOUBLE) / 61), 9) AS score FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS rank FROM fused)"""


@query(f"WITH {_CHANNELS} SELECT query_id, chunk_id, round(score, 6) AS score, round(dense_score, 6) AS dense_score, round(lexical_score, 6) AS lexical_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def rrf_fusion(spark, sf):
    """Vectors and whole texts fused by reciprocal rank."""
    fused = R.fuse(*_channels(spark, sf), 10)
    return fused.select("query_id", "chunk_id", *(F.round(c, 6).alias(c) for c in ("score", "dense_score", "lexical_score")), "rank")


@query(f"""WITH {_CHANNELS}, a2 AS (SELECT query_id, count(*) AS nd FROM a WHERE query_id % 3 <> 0 GROUP BY query_id), b2 AS (SELECT query_id, count(*) AS nl FROM b WHERE query_id % 3 <> 1 GROUP BY query_id),
f2 AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.chunk_id, y.chunk_id) AS chunk_id, x.score AS dense_score, x.rank AS dense_rank, y.score AS lexical_score, y.rank AS lexical_rank, round((coalesce(1.0 / (60 + x.rank), 0) + coalesce(1.0 / (60 + y.rank), 0)) / (CAST(2 AS DOUBLE) / 61), 9) AS score FROM (SELECT * FROM a WHERE query_id % 3 <> 0) x FULL OUTER JOIN (SELECT * FROM b WHERE query_id % 3 <> 1) y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS rank FROM f2)
SELECT r2.query_id, chunk_id, round(CASE WHEN nd IS NOT NULL AND nl IS NOT NULL THEN score WHEN nd IS NOT NULL THEN dense_score ELSE lexical_score END, 6) AS score, CASE WHEN nd IS NOT NULL AND nl IS NOT NULL THEN 'rrf' WHEN nd IS NOT NULL THEN 'dense' ELSE 'lexical' END AS method, CAST(rank AS INTEGER) AS rank FROM r2 LEFT JOIN a2 USING (query_id) LEFT JOIN b2 USING (query_id) WHERE rank <= 6""")
def hybrid_mode_dispatch(spark, sf):
    """Where one channel has no hits the other one answers."""
    a, b = _channels(spark, sf)
    out = R.hybrid(a.where("query_id % 3 <> 0"), b.where("query_id % 3 <> 1"), 6)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "method", "rank")


@query()
def hybrid_search(spark, sf):
    """Hashed embeddings and BM25 of whole texts fused; embeddings have no SQL, a test compares with plain Python."""
    fused = R.hybrid_search(R.active(chunks(spark, sf)), questions(spark, sf), 10, indexed_embedding_hits(spark, sf), lexical=lambda q, k: lexical(spark, sf, k, q))
    return fused.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "method", "rank")


@query(f"""WITH {CHUNKS}, {QUESTIONS}, low AS (SELECT chunk_id, lower(content) AS c FROM chunks WHERE status = 'completed' AND category = 'code'), q AS (SELECT query_id, unnest(list_distinct({tokens("question")})) AS t FROM questions),
m AS (SELECT query_id, chunk_id, CAST(sum((length(c) - length(replace(c, t, ''))) // length(t)) AS INTEGER) AS matched FROM low, q GROUP BY ALL),
r AS (SELECT *, least(1.0, matched / 5.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY least(1.0, matched / 5.0) DESC, chunk_id) AS rank FROM m WHERE matched > 0)
SELECT query_id, chunk_id, matched, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def keyword_search_code(spark, sf):
    return R.keyword_search(R.active(chunks(spark, sf)), questions(spark, sf), 6)


def _issues(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("text").alias("content"))


@query(f"""WITH {QUESTIONS}, c AS (SELECT conv_id * 1000 + turn AS chunk_id, unnest(list_distinct({tokens("text")})) AS term FROM conversations WHERE role = 'user'),
q AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM (SELECT query_id, list_distinct({tokens("question")}) AS t FROM questions)),
s AS (SELECT query_id, chunk_id, least(1.0, round(count(*) / CAST(any_value(n) AS DOUBLE), 9)) AS score FROM c JOIN q USING (term) GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 6""")
def issue_search_overlap(spark, sf):
    return R.overlap_search(_issues(spark, sf), questions(spark, sf), 6)


_HITS = f"{CHUNKS}, {QUESTIONS}, {bm25('hits', _ACTIVE, 20)}"


def _hits(spark, sf):
    return lexical(spark, sf, 20)


@query(f"WITH {_HITS} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(NULL AS DOUBLE) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM hits")
def rerank_identity(spark, sf):
    return R.rerank_identity(_hits(spark, sf)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rerank_score", "rank")


_RAW = "(CAST(chunk_id % 17 AS DOUBLE) - 8) / 2"


@query(f"""WITH {_HITS}, s AS (SELECT query_id, chunk_id, rank AS retrieval_rank, round(1 / (1 + exp(-({_RAW}))), 9) AS rerank_score FROM hits),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rerank_rank FROM s)
SELECT query_id, chunk_id, CAST(retrieval_rank AS INTEGER) AS retrieval_rank, CAST(rerank_rank AS INTEGER) AS rerank_rank, CAST(retrieval_rank - rerank_rank AS INTEGER) AS movement, rerank_rank <= 6 AS selected FROM r""")
def rank_movement(spark, sf):
    """Ranks before and after a stand-in reranker whose raw score follows from the chunk's id."""
    return R.rerank(_hits(spark, sf), F.expr(_RAW), 6).select("query_id", "chunk_id", "retrieval_rank", "rerank_rank", "movement", "selected")


@query("SELECT vec_id, round(1 / (1 + exp(-least(60.0, greatest(-60.0, CAST(embedding[1] AS DOUBLE) * 100)))), 9) AS score FROM embeddings")
def rerank_sigmoid(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(T.squash(F.col("embedding")[0].cast("double") * 100), 9).alias("score"))


@query("SELECT label, count(*) AS vectors, count(*) FILTER (vec_id % 50 <> 7) AS chunks, count(*) <> count(*) FILTER (vec_id % 50 <> 7) AS rebuild FROM embeddings GROUP BY label")
def vector_sync_check(spark, sf):
    """Sources whose vectors and active chunks differ in number are to be rebuilt."""
    v = table(spark, sf, "embeddings")
    n, m = F.count("*"), F.count(F.when(F.col("vec_id") % 50 != 7, 1))
    return v.groupBy("label").agg(n.alias("vectors"), m.alias("chunks"), (n != m).alias("rebuild"))


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (2, 5)")
def vector_delete_source(spark, sf):
    """Vectors that stay when two sources are deleted."""
    gone = spark.createDataFrame([(2,), (5,)], "label int")
    return table(spark, sf, "embeddings").join(F.broadcast(gone), "label", "left_anti").select("vec_id", "label")
