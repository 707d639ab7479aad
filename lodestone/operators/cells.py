"""Approximate search by cosine: vectors in cells, residual codes, exact rescoring.

`fit` finds the cells' centres on a bounded sample (SAMPLE rows by a hash of the key, over all rows) by k-means. `build` puts every vector, scaled to length one, in the cell of
its nearest centre; a row keeps the vector and a code: what the vector differs from the centre, a byte for each dimension. Rows are written once, by cell and slice: a cell of
very many vectors has slices of SLICE rows, so it is no single task. `search` compares a query with the codes of its nearest `probes` cells only, keeps RESCORED x k of
each task's best, takes the best RESCORED x k of all, and scores these exactly from their vectors. The codes travel once for all queries, whole vectors
only for candidates. How many cells must be probed for a stated recall is measured on the sample when the index is fitted, and the recall of an index can be measured against `dense`.

Null vectors, and those of another length than the sample's most common one, are in no cell. Vectors of length zero have cosine 0 with all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, top

#: Rows and numbers of the sample that centres are fitted on; the largest number of cells.
SAMPLE, SAMPLE_NUMBERS, CELLS = 50_000, 1 << 25, 4096
SLICE, RESCORED, TARGET = 50_000, 16, 0.97
ROUNDS = 12


@dataclass
class Cells:
    centres: np.ndarray  # cells x dimensions
    scale: np.ndarray  # what one step of a code is worth, for each cell
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + 4096] @ centres.T - half, 1) for a in range(0, len(x), 4096)] or [np.zeros(0, int)])


def fit(vectors: DataFrame, cells: int | None = None, k: int = 10, target: float = TARGET, seed: int = 5) -> Cells | None:
    """Centres, code scale and probes from a sample of vectors (chunk_id, vector) that the driver holds; None without a vector."""
    rows = vectors.where("vector IS NOT NULL AND size(vector) > 0")
    n = rows.count()
    if not n:
        return None
    width = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()["d"]
    wanted = min(SAMPLE, max(1000, SAMPLE_NUMBERS // width))
    share = min(1.0, 1.2 * wanted / n + 1e-9)
    drawn = rows.where((F.size("vector") == width) & (F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    sample = drawn.orderBy(F.xxhash64("chunk_id", F.lit(1))).limit(wanted).select(F.col("vector").cast("array<double>").alias("v")).collect()
    x = _unit(np.nan_to_num(np.array([r["v"] for r in sample])))
    rng = np.random.default_rng(seed)
    count = min(CELLS, len(x), cells or max(1, round(np.sqrt(n))))
    centres = x[rng.choice(len(x), count, replace=False)]
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(at, minlength=count)
        np.add.at(sums, at, x)
        empty = sizes == 0
        centres = np.where(empty[:, None], x[rng.choice(len(x), count)], sums / np.maximum(sizes, 1)[:, None])
    at = _nearest(x, centres)
    away = np.abs(x - centres[at]).max(1)
    scale = np.full(count, away.max())
    for c in np.flatnonzero(np.bincount(at, minlength=count) > 4):  # others have too few to tell
        scale[c] = 1.25 * away[at == c].max()
    scale = np.maximum(scale, 1e-9) / 127
    # how many cells hold the k nearest of a query: ranks of the cells of its true neighbours, in the sample
    asked = rng.choice(len(x), min(500, len(x)), replace=False)
    order = np.argsort(-(x[asked] @ centres.T), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(count)[None, :].repeat(len(asked), 0), 1)
    true = np.argsort(-(x[asked] @ x.T), axis=1, kind="stable")[:, : min(k, len(x))]
    places = np.sort(np.take_along_axis(rank, at[true], 1).ravel())
    probes = int(places[min(len(places) - 1, int(np.ceil(target * len(places))))]) + 1
    return Cells(centres, scale, min(count, probes))


def build(vectors: DataFrame, cells: Cells, path: str) -> DataFrame:
    """The table of cells below path: cell, slice, chunk_id, vector (of length one) and code. Each vector shuffles once."""
    spark, shared = vectors.sparkSession, vectors.sparkSession.sparkContext.broadcast(cells)  # CELLS rows at most
    kind = vectors.schema["chunk_id"].dataType.simpleString()
    width = cells.centres.shape[1]
    rows = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).where(f"vector IS NOT NULL AND size(vector) = {width}")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _unit(np.nan_to_num(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))
                cell = _nearest(x, c.centres)
                code = np.clip(np.rint((x - c.centres[cell]) / c.scale[cell][:, None]), -127, 127).astype(np.int8)
                columns = [pa.array(cell.astype(np.int32)), batch.column(0), pa.array([r.tobytes() for r in x.astype("<f8")]), pa.array([r.tobytes() for r in code])]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "chunk_id", "vector", "code"])

    placed = settled(rows.mapInArrow(place, f"cell int, chunk_id {kind}, vector binary, code binary"))
    sizes = settled(placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / SLICE).cast("int").alias("slices")))  # CELLS rows at most
    sliced = placed.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices")).cast("int"))
    sliced.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "chunk_id").select("cell", "slice", "slices", "chunk_id", "vector", "code").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def search(table: DataFrame, cells: Cells, query_vectors: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """About the k nearest vectors of each query (query_id, vector): query_id, chunk_id, score (exact), rank; equal scores by chunk_id."""
    spark, shared = table.sparkSession, table.sparkSession.sparkContext.broadcast(cells)
    width, pool, probes = cells.centres.shape[1], RESCORED * k, probes or cells.probes
    id_of, key_of = (df.schema[c].dataType.simpleString() for df, c in ((query_vectors, "query_id"), (table, "chunk_id")))
    rows = query_vectors.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(f"vector IS NOT NULL AND size(vector) = {width}")

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                q = _unit(np.nan_to_num(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))
                near = np.argsort(-(q @ c.centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in q.astype("<f8")]), lists], names=["query_id", "q", "cells"])

    asked = settled(rows.mapInArrow(probe, f"query_id {id_of}, q binary, cells array<int>"))
    sizes = F.broadcast(settled(table.select("cell", "slices").distinct()))
    probing = asked.select("query_id", "q", F.explode("cells").alias("cell")).join(sizes, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def compare(queries: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(queries) and len(held):
            c, cell = shared.value, held["cell"][0].as_py()
            x = np.frombuffer(b"".join(held["code"].to_pylist()), np.int8).reshape(-1, width) * c.scale[cell] + c.centres[cell]
            q = np.frombuffer(b"".join(queries["q"].to_pylist())).reshape(-1, width)
            for a in range(0, len(q), 64):
                score = q[a : a + 64] @ x.T
                m = min(pool, len(x))
                best = np.argpartition(-score, m - 1, axis=1)[:, :m]
                row = np.repeat(np.arange(len(best)), m)
                found.append((row + a, best.ravel(), score[row, best.ravel()]))
        at, of, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": queries["query_id"].take(pa.array(at)), "chunk_id": held["chunk_id"].take(pa.array(of)), "about": pa.array(score)})

    codes = table.select("cell", "slice", "chunk_id", "code")
    near = probing.groupBy("cell", "slice").cogroup(codes.groupBy("cell", "slice")).applyInArrow(compare, f"query_id {id_of}, chunk_id {key_of}, about double")
    candidates = settled(top(near, pool, ["query_id"], [F.desc("about"), F.asc("chunk_id")]).select("query_id", "chunk_id"))
    pairs = candidates.join(asked.select("query_id", "q"), "query_id").join(table.select("chunk_id", "vector"), "chunk_id")

    def rescore(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, v = (np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist())).reshape(-1, width) for c in ("q", "vector"))
                score = np.round((q * v).sum(1), 6) + 0.0
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("query_id")), b.column(b.schema.get_field_index("chunk_id")), pa.array(score)], names=["query_id", "chunk_id", "score"])

    scored = pairs.select("query_id", "chunk_id", "q", "vector").mapInArrow(rescore, f"query_id {id_of}, chunk_id {key_of}, score double")
    return top(scored, k, ["query_id"], [F.desc("score"), F.asc("chunk_id")])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id and the share of its exact hits that were found; of equal scores any are right."""
    wanted = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    right = found.join(wanted, "query_id").where("score >= least").groupBy("query_id").agg(F.count("*").alias("right"))
    return wanted.join(right, "query_id", "left").select("query_id", (F.coalesce("right", F.lit(0)) / F.col("n")).alias("recall"))
