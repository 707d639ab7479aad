"""Retrieval over a DataFrame of queries: one job answers all of them.

chunks: chunk_id, source_id, content (and status, category where an operator says so).
queries: query_id, question. Scores tie by chunk_id; ranks are on scores rounded to nine digits, so that the order of
summing doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, occurrences, squash, tokenize, words
from .common import BROADCAST_ROWS, bounded, known, settled, top
from .scoring import Asked, Best, best_of, within

K1, B = 1.5, 0.75
RRF_K = 60
#: Queries of a block, and numbers of a part's vectors, that meet in one task.
BLOCK, PART = 4096, 1 << 21
#: Occurrences of a query's terms in a chunk that make a score of one.
FULL = 5


def active(chunks: DataFrame) -> DataFrame:
    return chunks.where("status = 'completed'")


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Settled hits with the columns of texts (chunk_id, content, ...): bounded hits go to where the texts are, which take no shuffle."""
    return texts.join(bounded(hits), "chunk_id")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: a repeated term counts each time."""
    return queries.select("query_id", F.explode(tokenize("question")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, chunk_id, score (and rank up to k).

    Only terms that a query has are exploded further than the tokenizer; document lengths need no shuffle.
    """
    terms = query_terms(queries)
    # the terms that queries have bound every table by term
    few = terms.select("term").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    wanted = small(terms.select("term").distinct())
    asked = bounded(terms)  # a row for each query and term: counted by itself
    tokens = chunks.select("chunk_id", tokenize("content").alias("tokens"))
    corpus = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    found = tokens.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    tf = found.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(small(df), "term").join(F.broadcast(corpus))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1e-9))))
    each = weighed.select("chunk_id", "term", (idf * gain).alias("w")).join(asked, "term")
    scored = each.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qtf") * F.col("w")), 9).alias("score"))
    return scored if k is None else top(scored, k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)


def _cosines(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Cosines of rows of y with all of x, some rows at a time."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    for a in range(0, len(y), 64):
        yield a, np.round(y[a : a + 64] @ x.T / np.maximum(ny[a : a + 64, None] * nx, 1e-300), 6) + 0.0


def _known_nearest(v: DataFrame, asked: pa.Table, k: int, kinds: str) -> DataFrame:
    """The k nearest of each task's vectors to a block of queries that every task knows: vectors are read batch by batch and don't shuffle."""
    sent = v.sparkSession.sparkContext.broadcast((asked["query_id"].combine_chunks(), _matrix(asked["vector"])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = sent.value
        found = Best(k, np.full(len(y), -np.inf))
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = batch.column("chunk_id")
            order = pc.sort_indices(chunk)
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1)[order.to_numpy()]
            chunk = chunk.take(order)
            for a, score in _cosines(x, y):
                row, at = best_of(score, k)
                found.add(row + a, score[row, at], chunk.take(pa.array(at)))
        if (rows := found.cut()) is not None:
            yield from pa.table({"query_id": ids.take(pa.array(rows["query"].to_numpy())), "chunk_id": rows["chunk_id"], "score": rows["score"]}).combine_chunks().to_batches()

    return v.select("chunk_id", "vector").mapInArrow(run, kinds)


def dense(vectors: DataFrame, query_vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest vectors of each query by cosine. Null vectors are near nothing.

    Up to a block of queries is known to all tasks, which read vectors in batches and keep the k best of their own. Of more, each block meets each part of the
    vectors, PART numbers, in one task. Either way rows grow with the queries, not with the pairs, and a task's memory with neither.
    """
    v = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    q = query_vectors.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    kinds, order = f"query_id {kind(q, 'query_id')}, chunk_id {kind(v, 'chunk_id')}, score double", [F.desc("score"), F.asc("chunk_id")]
    asked = q.limit(block + 1).toArrow()
    if 0 < len(asked) <= block:
        return top(_known_nearest(v, asked, k, kinds), k, ["query_id"], order)
    blocks, width = max(1, -(-query_vectors.count() // block)), len(asked["vector"][0]) if len(asked) else 1
    parts = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // max(1, PART // max(1, width))))
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("part", place("chunk_id", parts)).withColumn("block", every(blocks))
    q = q.withColumn("block", place("query_id", blocks)).withColumn("part", every(parts))

    def nearest(some: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(some) and len(asked):
            some = some.sort_by("chunk_id")
            for a, score in _cosines(_matrix(some["vector"]), _matrix(asked["vector"])):
                row, at = best_of(score, k)
                found.append((row + a, at, score[row, at]))
        rows, at, scores = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": asked["query_id"].take(pa.array(rows)), "chunk_id": some["chunk_id"].take(pa.array(at)), "score": pa.array(scores)})

    hits = v.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInArrow(nearest, kinds)
    return top(hits, k, ["query_id"], order)


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, k: int, rrf_k: int = RRF_K, dense_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked channels (query_id, chunk_id, score, rank); both raw scores stay.

    Equal scores keep the dense channel's order, then the lexical one's.
    """
    d = dense_hits.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    x = lexical_hits.select("query_id", "chunk_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    part = lambda w, r: F.coalesce(w / (rrf_k + F.col(r)), F.lit(0.0))
    best = (dense_weight + lexical_weight) / (rrf_k + 1)
    score = (part(dense_weight, "dense_rank") + part(lexical_weight, "lexical_rank")) / best
    fused = d.join(x, ["query_id", "chunk_id"], "full_outer").withColumn("score", F.round(score, 9))
    return top(fused, k, ["query_id"], [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), F.asc("chunk_id")])


def hybrid(dense_hits: DataFrame, lexical_hits: DataFrame, k: int) -> DataFrame:
    """Per query: both channels fused if both have hits, else the one that has; method says which."""
    counts = dense_hits.groupBy("query_id").agg(F.count("*").alias("nd")).join(lexical_hits.groupBy("query_id").agg(F.count("*").alias("nl")), "query_id", "full_outer")
    method = F.when(F.col("nd").isNotNull() & F.col("nl").isNotNull(), "rrf").when(F.col("nd").isNotNull(), "dense").otherwise("lexical")
    methods = counts.select("query_id", method.alias("method"))
    # either channel alone keeps its own scores; fusion over a single channel has the same order
    out = fuse(dense_hits, lexical_hits, k).join(methods, "query_id")
    score = F.when(F.col("method") == "rrf", F.col("score")).when(F.col("method") == "dense", F.col("dense_score")).otherwise(F.col("lexical_score"))
    return out.withColumn("score", score)


#: Candidates that each channel of a search brings at least.
CANDIDATES = 20


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int, embedded: Callable | None, mode: str = "hybrid", lexical: Callable | None = None) -> DataFrame:
    """The k best chunks of each query by both channels, or by one: query_id, chunk_id, score, method, rank.

    embedded: chunks, queries, k -> hits of the dense channel; without it only the lexical one answers. lexical: queries, k -> hits of
    the lexical channel, from an index say; without it BM25 scans the chunks. Each channel brings a pool
    of three times k, CANDIDATES at least. Where the dense channel has nothing, the lexical one answers, in mode dense too.
    """
    if mode not in ("hybrid", "dense", "lexical"):
        raise ValueError("mode is hybrid, dense or lexical")
    pool = max(3 * k, CANDIDATES)
    worded = bm25(chunks, queries, pool) if lexical is None else lexical(queries, pool)
    if embedded is None or mode == "lexical":
        return worded.where(F.col("rank") <= k).select("query_id", "chunk_id", "score", F.lit("lexical").alias("method"), "rank")
    near = embedded(chunks, queries, pool)
    if mode == "dense":
        worded = worded.join(near.select("query_id").distinct(), "query_id", "left_anti")
    return hybrid(near, worded, k).select("query_id", "chunk_id", "score", "method", "rank")


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int, code_only: bool = True) -> DataFrame:
    """Occurrences of a query's distinct terms in a chunk, anywhere in its words, in fifths, one at most.

    Terms of up to BROADCAST_ROWS queries' terms together are known to all tasks, which count them in the chunks they read, batch by batch, and send on k rows a
    query: no row is made for a pair of query and chunk, and no text shuffles. Of more, a term lies within a run of word characters, so each distinct run is
    searched once for the terms of all queries: those whose first three characters (all of a shorter term) it has, by a join. Only runs that have a term go on: their
    counts, broadcast if they are few, meet the words of the chunks before these are shuffled.
    """
    wanted = chunks.where("category = 'code'") if code_only else chunks
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize("question"))).alias("term"))
    order = [F.desc("score"), F.asc("chunk_id")]
    if known(terms):
        asked = terms.select("query_id", "term", F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("least")).toArrow()
        sent = chunks.sparkSession.sparkContext.broadcast(Asked(asked))
        runs = wanted.select("chunk_id", F.coalesce(words("content"), F.array().cast("array<string>")).alias("runs"))
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        found = runs.mapInArrow(within(lambda: sent.value, k, FULL), f"query_id {kind(queries, 'query_id')}, chunk_id {kind(chunks, 'chunk_id')}, matched int, score double")
        return top(found, k, ["query_id"], order)
    keyed = terms.select("term").distinct().withColumn("key", F.substring("term", 1, 3))
    parts = lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - (n - 1)), lambda i: F.substring(F.col("run"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    single = F.when(F.col("run").rlike(CJK), parts(1)).otherwise(F.array().cast("array<string>"))  # only these make terms of one character
    runs = wanted.select(F.explode(F.array_distinct(words("content"))).alias("run")).distinct()
    cut = runs.select("run", F.explode(F.array_distinct(F.concat(parts(3), parts(2), single))).alias("key"))
    counted = settled(cut.join(bounded(keyed), "key").where(F.contains(F.col("run"), F.col("term"))).select("run", "term", occurrences(F.col("run"), F.col("term")).alias("n")).distinct())
    each = wanted.select("chunk_id", F.explode(words("content")).alias("run")).join(bounded(counted), "run").groupBy("chunk_id", "term").agg(F.sum("n").alias("n"))
    hits = each.join(bounded(terms), "term").groupBy("query_id", "chunk_id").agg(F.sum("n").cast("int").alias("matched"))
    scored = hits.select("query_id", "chunk_id", "matched", F.least(F.lit(1.0), F.col("matched") / FULL).alias("score"))
    return top(scored, k, ["query_id"], order)


def overlap_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Share of a query's distinct terms that a chunk has; an equi-join on the terms."""
    q = queries.select("query_id", F.array_distinct(tokenize("question")).alias("terms")).select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    c = chunks.select("chunk_id", F.explode(F.array_distinct(tokenize("content"))).alias("term"))
    scored = c.join(bounded(q), "term").groupBy("query_id", "chunk_id").agg((F.count("*") / F.first("n")).alias("score"))
    return top(scored.withColumn("score", F.least(F.lit(1.0), F.round("score", 9))), k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])


def rerank_identity(hits: DataFrame) -> DataFrame:
    """Hits by retrieval score, without a rerank score; of equal ones that which was brought first (column ord, if there is one)."""
    order = [F.desc("score"), *([F.asc("ord")] if "ord" in hits.columns else []), F.asc("chunk_id")]
    return top(hits.drop("rank").withColumn("rerank_score", F.lit(None).cast("double")), 1 << 30, ["query_id"], order)


def rerank_or_keep(hits: DataFrame, scored: DataFrame, failed: DataFrame) -> DataFrame:
    """Hits (query_id, chunk_id, score, ord) by the logistic of a reranker's raw score (scored: query_id, chunk_id, raw); queries in failed keep their retrieval order.

    retrieval_rank and rank are the places before and after; rerank_score is null where the reranker failed.
    """
    before = rerank_identity(hits).drop("rerank_score").withColumnRenamed("rank", "retrieval_rank")
    joined = before.join(scored.select("query_id", "chunk_id", "raw"), ["query_id", "chunk_id"], "left").join(failed.select("query_id", F.lit(True).alias("_failed")), "query_id", "left")
    kept = joined.withColumn("rerank_score", F.when(F.col("_failed").isNull(), F.round(squash(F.col("raw")), 9))).drop("raw", "_failed")
    return top(kept, 1 << 30, ["query_id"], [F.desc_nulls_last("rerank_score"), F.asc("retrieval_rank")])


def rerank(hits: DataFrame, raw: Column, k: int) -> DataFrame:
    """Hits by the logistic of a raw score, with both ranks, the movement between them and whether a hit is selected."""
    scored = hits.withColumnRenamed("rank", "retrieval_rank").withColumn("rerank_score", F.round(squash(raw), 9))
    ranked = top(scored, 1 << 30, ["query_id"], [F.desc("rerank_score"), F.asc("chunk_id")], "rerank_rank")
    return ranked.withColumn("movement", F.col("retrieval_rank") - F.col("rerank_rank")).withColumn("selected", F.col("rerank_rank") <= k)
