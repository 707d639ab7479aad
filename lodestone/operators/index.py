"""An inverted index over chunks: postings in blocks with their maxima, written once, and top-k search that skips blocks.

Chunks are put in order (of a source, say, so that like ones are neighbours) and numbered; BLOCK neighbours are a block, SUPER blocks a superblock.
A posting is a row for each term and block: the chunks of the block that have the term, how often, their lengths, and the largest gain that
the term brings to any of them. What a query can score in a block is at most the sum of its terms' largest gains there.

A search bounds superblocks, then the blocks of the best ones; scores the most promising blocks in full, which gives each query a
k-th score; and then scores only blocks whose bound reaches that score. Results are those of scoring every chunk, rows grow with the blocks that count, and
no row is made for a chunk that shares only common words with a query.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from . import scoring
from .common import bounded, settled, top
from .common import known as _known
from .retrieval import K1, B, query_terms
from .versions import Files

BLOCK, SUPER = 64, 256
#: Superblocks, and blocks, that are looked at first for a query's k-th score.
FIRST_SUPERS, FIRST_BLOCKS = 2, 4
#: Bytes of text, about, that a task sorts while the index is built; and ranges up to which the shuffle into them holds no texts (spark.shuffle.sort.bypassMergeThreshold), made
#: beyond that only if there are as many partitions of chunks.
RANGE, RANGES = 1 << 25, 200
#: What a bound may lack by rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """n chunks of mean length avgdl. Tables below path: forward, postings, maxima, supers, terms."""

    path: str
    n: int
    avgdl: float

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def gain(avgdl: float, tf: Column, dl: Column) -> Column:
    """What a term that a chunk has tf times brings, before its rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.greatest(F.lit(avgdl), F.lit(1e-9))))


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks (block, chunk_id, dl, tokens), a block's together, to postings: term, block, and the chunks that have the term."""
    for rows in scoring.whole_blocks(batches):
        flat = rows.column("tokens").flatten().dictionary_encode()
        starts = np.diff(rows.column("block").to_numpy(), prepend=rows.column("block")[0].as_py()) != 0
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("tokens")).to_numpy(zero_copy_only=False))
        # one number for each term, block and row, in that order: a term's rows are neighbours in the file without a sort of lists
        block = starts.cumsum()
        width = int(block[-1]) + 1
        key, tf = np.unique((flat.indices.to_numpy() * width + block[row]) * rows.num_rows + row, return_counts=True)
        listed, row = key // rows.num_rows, key % rows.num_rows
        first = np.flatnonzero(np.diff(listed, prepend=-1))
        fields = pa.StructArray.from_arrays([rows.column("chunk_id").take(pa.array(row)), pa.array(tf, pa.int32()), rows.column("dl").take(pa.array(row))], names=["chunk_id", "tf", "dl"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)], pa.int32()), fields)
        yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(listed[first] // width)), rows.column("block").take(pa.array(row[first])), lists], names=["term", "block", "list"])


def build(chunks: DataFrame, path: str, order: tuple[str, ...] = ("source_id",), block: int = BLOCK) -> Index:
    """The index of chunks (chunk_id, content and the columns of the order), written below path.

    Null contents have no terms. The corpus is tokenized once, and texts shuffle once, into their order: there are as many ranges as the texts' bytes take, up to RANGES, so what a
    task sorts does not follow the partitions of chunks. Postings take no shuffle, since a block's chunks are neighbours in one
    file: a task lists a block's terms and goes on, without a sort, which would spill every list; a term that every chunk has is as many rows as there are blocks. Should a block be read by two tasks its terms have two rows, whose
    bounds add up, which is still a bound.
    """
    spark, kind = chunks.sparkSession, chunks.schema["chunk_id"].dataType.simpleString()
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    ranges = max(1, chunks.rdd.getNumPartitions(), min(RANGES, math.ceil(size / RANGE)))
    spread = chunks.select("chunk_id", *order, "content").repartitionByRange(ranges, *order, "chunk_id")
    ordered = spread.sortWithinPartitions(*order, "chunk_id").select("chunk_id", F.coalesce(tokenize("content"), F.array().cast("array<string>")).alias("tokens"))
    # a partition's numbers begin at a multiple of 2^33, so no block has chunks of two partitions
    numbered = ordered.withColumn("block", F.expr(f"monotonically_increasing_id() div {block}"))
    numbered.select("chunk_id", "block", F.size("tokens").alias("dl"), "tokens").write.mode("overwrite").parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    n, length = forward.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    made = Index(path, n, length)
    listed = forward.select("block", "chunk_id", "dl", "tokens").mapInArrow(_listed, f"term string, block long, list array<struct<chunk_id:{kind},tf:int,dl:int>>")
    most = F.array_max(F.transform("list", lambda x: gain(length, x["tf"], x["dl"])))
    listed.select("term", "block", F.size("list").cast("long").alias("n"), most.alias("most"), "list").write.mode("overwrite").parquet(f"{path}/postings")
    maxima = spark.read.parquet(f"{path}/postings").select("term", "block", "n", "most").withColumn("super", F.expr(f"block div {SUPER}"))
    maxima.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    highest = maxima.groupBy("term", "super").agg(F.max("most").alias("most"))
    highest.repartition("super").sortWithinPartitions("super").write.mode("overwrite").parquet(f"{path}/supers")
    return made


def opened(spark: SparkSession, chunks: Callable[[], DataFrame], folder: str, properties: dict, order: tuple[str, ...] = ("source_id",)) -> Index:
    """The index below folder if it was made with these properties (what the chunks are read from, in which state); else it is built.

    The manifest is written last and names the tables' folder, so a build that broke off is not seen; of two builders the first one's is used.
    """
    config = {"k1": K1, "b": B, "block": BLOCK, "super": SUPER, "order": list(order), **properties}
    name = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    files, manifest = Files(spark, folder), f"{folder.rstrip('/')}/index-{name}.json"
    if f"index-{name}.json" not in files.names(folder):
        made = build(chunks(), f"{folder.rstrip('/')}/index-{name}-{uuid.uuid4().hex}", order)
        files.create(manifest, json.dumps({"path": made.path, "n": made.n, "avgdl": made.avgdl, "config": config}))
    found = json.loads(files.read(manifest))
    return Index(found["path"], found["n"], found["avgdl"])


def state(spark: SparkSession, path: str) -> dict:
    """What tells one state of a table's files from another: their number, bytes, newest time, and a hash of all that and their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    r = files.agg(F.count("*"), F.sum("length"), F.max("modificationTime").cast("string"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return {"path": path, "files": r[0], "bytes": r[1], "newest": r[2], "hash": r[3]}


def asked_terms(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, term, qtf and idf of the terms that the index has."""
    spark = queries.sparkSession
    idf = F.log1p((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return settled(query_terms(queries).join(index.table(spark, "terms"), "term").select("query_id", "term", "qtf", idf.alias("idf")))


def _bound(rows: DataFrame, place: str) -> DataFrame:
    return rows.groupBy("query_id", place).agg(F.sum(F.col("qtf") * F.col("idf") * F.col("most")).alias("bound"))


def _scored(index: Index, asked: DataFrame, places: DataFrame) -> DataFrame:
    """query_id, chunk_id and score of every chunk of places (query_id, block) that has a term of the query."""
    wanted = settled(asked.join(places, "query_id").select("query_id", "block", "term", "qtf", "idf"))
    postings = index.table(asked.sparkSession, "postings").select("term", "block", "list")
    some = bounded(wanted)
    if some is wanted:  # both sides shuffle: postings of no query's term, or of blocks that no query looks at, must not
        for c in ("term", "block"):
            postings = postings.join(bounded(settled(wanted.select(c).distinct())), c, "left_semi")
    met = postings.join(some, ["term", "block"])
    each = met.select("query_id", "qtf", "idf", F.inline("list"))
    return each.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qtf") * (F.col("idf") * gain(index.avgdl, F.col("tf"), F.col("dl")))), 9).alias("score"))


def _sent(asked: DataFrame, least: DataFrame | None = None) -> Callable[[], scoring.Asked]:
    """asked, which is _known, as tasks get it; with least (query_id, least) the scores that hits must reach."""
    weighed = asked.withColumn("weight", F.col("qtf") * F.col("idf"))
    weighed = weighed.withColumn("least", F.lit(None).cast("double")) if least is None else weighed.join(bounded(least), "query_id", "left")
    sent = asked.sparkSession.sparkContext.broadcast(scoring.Asked(weighed.select("query_id", "term", "weight", "least").toArrow()))
    return lambda: sent.value


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _in_tasks(index: Index, asked: DataFrame, least: DataFrame, open_: DataFrame, k: int, work: bool) -> DataFrame:
    """The k best chunks of each query in the superblocks open_, or the work, found by the tasks that have the chunks: a row for each task, query and hit."""
    forward = index.table(asked.sparkSession, "forward")
    near = forward.withColumn("super", F.expr(f"block div {SUPER}")).join(bounded(settled(open_.select("super").distinct())), "super", "left_semi")
    run = scoring.best(_sent(asked, least), k, K1, B, index.avgdl, SLACK, work)
    columns = "blocks long, blocks_scored long, pairs_scored long" if work else f"chunk_id {_kind(forward, 'chunk_id')}, score double"
    return near.select("block", "chunk_id", "dl", "tokens").mapInArrow(run, f"query_id {_kind(asked, 'query_id')}, {columns}")


def search(index: Index, queries: DataFrame, k: int, work: bool = False) -> DataFrame:
    """The k best chunks of each query (query_id, question): query_id, chunk_id, score, rank; as bm25 finds them.

    Queries of up to BROADCAST_ROWS terms together are known to all tasks, which score the chunks they read and send on k rows a query; beyond, queries
    and postings meet by term and block in a shuffle.

    work: instead, query_id, blocks that have a term of it, blocks scored and pairs (of query and chunk) scored. Of queries known to all tasks the blocks are those
    of open superblocks, and a block that two tasks read counts twice.
    """
    spark = queries.sparkSession
    asked = asked_terms(index, queries)
    few, known, highest = bounded(asked), _known(asked), index.table(spark, "supers").select("super", "term", "most")
    if known:
        parts = highest.mapInArrow(scoring.bounds(_sent(asked)), f"query_id {_kind(asked, 'query_id')}, super long, bound double")
        supers = settled(parts.groupBy("query_id", "super").agg(F.sum("bound").alias("bound")))
    else:
        supers = settled(_bound(highest.join(few, "term"), "super"))
    maxima = index.table(spark, "postings").select("term", "block", "most").withColumn("super", F.expr(f"block div {SUPER}"))

    def blocks(within: DataFrame) -> DataFrame:
        """Bounds of the blocks of superblocks (query_id, super)."""
        wanted = settled(few.join(within, "query_id").select("query_id", "term", "qtf", "idf", "super"))
        return _bound(maxima.join(bounded(wanted), ["term", "super"]), "block")

    best = lambda rows, place, m: top(rows, m, ["query_id"], [F.desc("bound"), F.asc(place)]).select("query_id", place)
    near = best(blocks(best(supers, "super", FIRST_SUPERS)), "block", FIRST_BLOCKS)
    tried = top(_scored(index, asked, near), k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])
    least = settled(tried.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")))
    reaches = F.col("bound") + SLACK >= F.coalesce("least", F.lit(0.0))
    open_ = supers.join(bounded(least), "query_id", "left").where(reaches).select("query_id", "super")
    order = [F.desc("score"), F.asc("chunk_id")]
    if known:
        found = _in_tasks(index, asked, least, open_, k, work)
        if not work:
            return top(found, k, ["query_id"], order)
        sums = found.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("blocks", "blocks_scored", "pairs_scored")))
        return sums.where("blocks > 0")
    places = blocks(open_).join(bounded(least), "query_id", "left").where(reaches).select("query_id", "block")
    if work:
        places = settled(places)
        pairs = _scored(index, asked, places).groupBy("query_id").agg(F.count("*").alias("pairs_scored"))
        counted = places.groupBy("query_id").agg(F.count("*").alias("blocks_scored"))
        all_blocks = _bound(maxima.join(few, "term"), "block").groupBy("query_id").agg(F.count("*").alias("blocks"))
        return all_blocks.join(counted, "query_id").join(pairs, "query_id")
    return top(_scored(index, asked, places), k, ["query_id"], order)
