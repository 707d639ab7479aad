"""Importance resampling: documents drawn by the ratio of two hashed n-gram models, with Gumbel top-k.

The features of a text are its tokens (words in lower case, and runs of marks) and pairs of neighbouring tokens, hashed
into BUCKETS. The target model is the distribution of the features of documents known to be good, the raw model
that of all documents. A document's log weight is the sum over its features of log target - log raw probability. Adding
Gumbel noise and keeping the k largest draws k documents without replacement in proportion to their weights.

The raw model counts every document, the target model every one that is labelled good; a document's own features are taken off the
counts of each model that has it before it is weighed, so a good document gains nothing by having been counted. Noise is hashed from
doc_id (and the text where it is null).

Null and empty texts have no features and log weight 0. A very long text is read whole, and memory follows it. Repeated rows have equal keys;
which of equal rows around the k-th place stay is decided by their order in the written table, so exactly k rows stay. An empty table gives no rows. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import flagged, groups, map_adding, portions, texts_of, written

BUCKETS, SEED = 10_000, 5
CACHED_TOKENS = 300_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hasher:
    """Texts to hashed features; keeps the hashes of tokens seen lately."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all texts, and to which text each belongs (ascending)."""
        if len(self.known) > CACHED_TOKENS:
            self.known = {}
        split = [_TOKEN.findall(t.lower()) for t in texts]
        known = self.known
        for t in set().union(*split).difference(known):
            known[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
        get = known.__getitem__
        lengths = np.array([len(s) for s in split], np.int64)
        codes = np.fromiter((c for s in split for c in map(get, s)), np.uint64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)
        inside = owner[:-1] == owner[1:]
        features = np.concatenate([codes % np.uint64(BUCKETS), pairs[inside] % np.uint64(BUCKETS)]).astype(np.int64)
        owners = np.concatenate([owner, owner[:-1][inside]])
        return features, owners


def log_weights(features: np.ndarray, owners: np.ndarray, good: np.ndarray, raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each text (good: whether the target has counted it) the sum over its features of log target - log raw probability.

    One is added to each count; the text's own features are taken off first.
    """
    n = len(good)
    keys, own = np.unique(owners * BUCKETS + features, return_counts=True)
    text, bucket = keys // BUCKETS, keys % BUCKETS
    size = np.bincount(owners, minlength=n)
    log = lambda counts, counted: np.log((counts[bucket] - own * counted[text] + 1) / (counts.sum() - size * counted + BUCKETS)[text])
    return np.bincount(text, own * (log(target, good.astype(np.int64)) - log(raw, np.ones(n, np.int64))), n)


def models(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts of all docs (text, good) and of the good ones: BUCKETS numbers each, summed up by Spark."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, raw, target = Hasher(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in portions(batches):
            texts, good = texts_of(batch), np.array(batch.column(1).to_pylist(), bool)
            done = 0
            for some in groups(texts, len(texts)):
                features, owners = hasher(some)
                raw += np.bincount(features, minlength=BUCKETS)
                target += np.bincount(features[good[owners + done]], minlength=BUCKETS)
                done += len(some)
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in docs.select("text", "good").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def gumbel(keys: np.ndarray) -> np.ndarray:
    """Gumbel noise hashed from integers."""
    x = keys.astype(np.uint64) + np.uint64(SEED * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    u = ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) + 0.5
    return -np.log(-np.log(u / (1 << 53)))


def sortable(x: np.ndarray) -> np.ndarray:
    """Longs in the order of doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def with_keys(docs: DataFrame, raw: np.ndarray, target: np.ndarray) -> DataFrame:
    """docs (doc_id, text, good) plus n_features, log_weight, gumbel_key and _llm_order (a long that sorts as the key)."""
    hashers: list[Hasher] = []

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not hashers:
            hashers.append(Hasher())
        texts, n, weight = texts_of(batch), [], []
        good = np.array(batch.column(batch.schema.get_field_index("good")).to_pylist(), bool)
        for some in groups(texts, len(texts)):
            features, owners = hashers[0](some)
            weight.append(log_weights(features, owners, good[sum(map(len, n)) :][: len(some)], raw, target))
            n.append(np.bincount(owners, minlength=len(some)))
        n, weight = np.concatenate(n), np.concatenate(weight)
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        keys = np.array([(zlib.crc32(t.encode("utf-8", "surrogatepass")) | 1 << 40 if i is None else i) & (1 << 64) - 1 for i, t in zip(ids, texts, strict=True)], np.uint64)
        key = weight + gumbel(keys)
        return {"n_features": pa.array(n.astype(np.int64)), "log_weight": pa.array(weight), "gumbel_key": pa.array(key), "_llm_order": pa.array(sortable(key))}

    return map_adding(docs, {"n_features": "long", "log_weight": "double", "gumbel_key": "double", "_llm_order": "long"}, add)


def kth_largest(rows: DataFrame, columns: list[str], k: int) -> tuple[int, ...] | None:
    """The k-th largest tuple of non-null longs, by radix selection: 16 bits at a time are counted, 65,536 counts at most."""
    found: list[int] = []
    for column in columns:
        value, fixed = F.expr(f"`{column}` ^ (-9223372036854775807L - 1L)"), 0  # in the order of unsigned numbers
        for shift in (48, 32, 16, 0):
            here = rows if shift == 48 else rows.where(F.call_function("shiftrightunsigned", value, F.lit(shift + 16)) == fixed)
            counts = here.groupBy((F.call_function("shiftrightunsigned", value, F.lit(shift))).alias("at")).count().collect()
            for r in sorted(counts, reverse=True):
                if r["count"] >= k:
                    fixed = r["at"]
                    break
                k -= r["count"]
            else:
                return None
        signed = (fixed & (1 << 64) - 1) ^ 1 << 63
        found.append(signed - (1 << 64) if signed >> 63 else signed)
        rows = rows.where(F.col(column) == found[-1])
    return tuple(found)


def resample(docs: DataFrame, good: DataFrame, share: float) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key and kept (the share with the largest keys, rounded) of every document.

    good: doc_id of documents of the target.
    """
    rows = flagged(docs.select("doc_id", "text"), good, "good")
    scored = written(with_keys(rows, *models(rows)).drop("text", "good").withColumn("_llm_row", F.monotonically_increasing_id()), "resampling")
    k = round(share * scored.count())
    least = kth_largest(scored, ["_llm_order", "_llm_row"], k) if k else None
    kept = F.lit(False) if least is None else (F.col("_llm_order") > least[0]) | (F.col("_llm_order") == least[0]) & (F.col("_llm_row") >= least[1])
    return scored.withColumn("kept", kept).drop("_llm_order", "_llm_row")


def good_share(labels: DataFrame) -> float:
    """The share of labelled documents of quality 1 (1 without labels)."""
    share = labels.where("quality IN (0, 1)").agg(F.avg("quality")).first()[0]
    return 1.0 if share is None else share
