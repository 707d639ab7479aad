"""Cross-entropy difference: each document's loss per token under a target model less that under a background model.

Both are bigram models over one vocabulary, that of a public tokenizer, so their losses compare token by token. The
background counts all documents, the target those whose doc_id `good` has. They are matched: the background's smoothing
grows with its size as if its counts were scaled to the target's, and both leave the scored document out (its own counts
are taken off those of each model that has it), so a document of the target is no nearer to it by having been counted.

    p(w | v) = (c(v, w) + mu p(w)) / (c(v) + mu),   p(w) = (c(w) + 1) / (N + V),   mu = SMOOTHING x N / N target

Counts of pairs are gathered from the whole corpus: each task sends its own in ranges of the first token, of some RANGE_PAIRS
possible pairs each, and each range is merged (in two steps for a large corpus) and written as a sorted file in the shared folder.
Up to MODEL_PAIRS pairs in a folder that all machines mount, scoring tasks map these files into memory. Otherwise no task reads the
model: each block of documents sends its different pairs to the ranges, tasks that hold one range answer with the counts, and the
answers meet the block again. A frequent pair is one number in a request like any other. Both ways give the same result.

Null and empty texts have no tokens, and losses and score 0. A very long text is encoded whole, and memory follows it. Repeated rows count
as documents of their own, each left out of its own score only. There are no ties to break. An empty table gives no rows. Columns other than doc_id and text
are not read. Without target documents the target model is uniform. Rows without an id are not of the target.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder, tokenizer_path
from .shared import file_system, flagged, partitions, portions, shared_dir, written

SMOOTHING = 50.0
#: Pairs up to which scoring tasks map the model.
MODEL_PAIRS = 100_000_000
#: Possible pairs of a range, about; tokens that one task merges into a range, and that one task answers for.
RANGE_PAIRS, MERGED_TOKENS, ANSWERED_TOKENS = 2_000_000, 1_000_000_000, 200_000_000
#: Tokens of a block of documents (or one document).
BLOCK_TOKENS = 1_000_000
_HELD = 2_000_000


def _vocabulary(path: str) -> int:
    return len(encoder(path).packed)


def encoded(docs: DataFrame, good: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, target, width and ids of docs, and block: the number of a run of documents; written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, block, held = encoder(tokenizer), TaskContext.get().partitionId() << 32, 0
        for batch in portions(batches):
            ids, blocks = enc.raw([x or "" for x in batch.column(1).to_pylist()]), []
            width = enc.dtype.itemsize
            for raw in ids:
                if held and held + len(raw) > BLOCK_TOKENS * width:
                    block, held = block + 1, 0
                held += len(raw)
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blocks, pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "target", "block", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(flagged(rows, good, "target").mapInArrow(run, "doc_id long, target boolean, block long, width int, ids binary"), "lm-tokens")


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a batch's documents (columns target, width, ids), the document of each, and which documents are of the target."""
    raw = batch.column(batch.schema.get_field_index("ids")).to_pylist()
    width = batch.column(batch.schema.get_field_index("width")).to_pylist()
    target = np.array(batch.column(batch.schema.get_field_index("target")).to_pylist(), bool)
    ids = np.frombuffer(b"".join(raw), f"<u{width[0]}").astype(np.int64) if raw else np.zeros(0, np.int64)
    return ids, np.repeat(np.arange(len(raw)), [len(r) // width[0] for r in raw]), target


def _pairs(ids: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """The key of each token with the token before it (size: the beginning of a document)."""
    before = np.empty_like(ids)
    if len(ids):
        before[0] = size
        before[1:] = np.where(owner[1:] == owner[:-1], ids[:-1], size)
    return before * (size + 1) + ids


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and sums of counts."""
    if not len(keys):
        return keys, *counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
    return keys[first], *(np.add.reduceat(c[order], first) for c in counts)


class Unigrams:
    """Counts of each token, all and target, and of each context (the beginning of a document is the last)."""

    def __init__(self, size: int, counts: np.ndarray, contexts: np.ndarray):
        self.size, self.contexts = size, contexts
        total = counts.sum(1)
        self.mu = SMOOTHING * np.array([total[0] / max(1, total[1]), 1.0])
        self.p = (counts + 1) / (total[:, None] + size)

    def log_p(self, keys: np.ndarray, pairs: np.ndarray, own: np.ndarray, own_context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities under background and target of pairs whose counts are given, less the document's own."""
        v, w = keys // (self.size + 1), keys % (self.size + 1)
        out = []
        for m, counted in ((0, np.ones(len(keys), bool)), (1, target)):
            c, n = pairs[m] - own * counted, self.contexts[m][v] - own_context * counted
            out.append(np.log((c + self.mu[m] * self.p[m][w]) / (n + self.mu[m])))
        return out[0], out[1]


def unigrams(tokens: DataFrame, size: int) -> Unigrams:
    """size + 1 counts at most come to the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, size + 1), np.int64)
        for batch in portions(batches):
            ids, owner, target = _tokens(batch)
            mine = target[owner]
            last = np.r_[owner[1:] != owner[:-1], True] if len(ids) else np.zeros(0, bool)
            total[0] += np.bincount(ids, minlength=size + 1)
            total[1] += np.bincount(ids[mine], minlength=size + 1)
            total[2] += np.bincount(ids[~last], minlength=size + 1)
            total[3] += np.bincount(ids[~last & mine], minlength=size + 1)
            total[2, size] += last.sum()
            total[3, size] += (last & mine).sum()
        at = np.nonzero(total.any(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], names=["id", "c0", "c1", "v0", "v1"])

    out = np.zeros((4, size + 1))
    for r in tokens.select("target", "width", "ids").mapInArrow(count, "id long, c0 long, c1 long, v0 long, v1 long").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "v0", "v1"))).collect():
        out[:, r["id"]] = r["c0"], r["c1"], r["v0"], r["v1"]
    return Unigrams(size, out[:2, :size], out[2:])


def _ranges(uni: Unigrams, count: int) -> np.ndarray:
    """First tokens at which ranges with about equally many possible pairs begin: count ranges, or more if they would be too large."""
    load = np.cumsum(np.minimum(uni.contexts[0], uni.size))
    count = max(count, int(-(-load[-1] // RANGE_PAIRS)))
    return np.unique(np.searchsorted(load, load[-1] * np.arange(1, count) / count, "right"))


_SENT = "range int, salt int, keys binary, b binary, t binary"


def _packed_counts(keys: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys, as differences, and their counts; all 64 bits wide (Spark compresses what it shuffles)."""
    return np.diff(keys, prepend=0).astype("<u8").tobytes(), b.astype("<u8").tobytes(), t.astype("<u8").tobytes()


def _counts(keys: bytes, b: bytes, t: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(keys, "<u8"), dtype=np.int64), np.frombuffer(b, "<u8").astype(np.int64), np.frombuffer(t, "<u8").astype(np.int64)


def _rows_of(number: int, salt: int, keys: np.ndarray, b: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 500_000):
        packed = _packed_counts(keys[i : i + 500_000], b[i : i + 500_000], t[i : i + 500_000])
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([salt], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["range", "salt", "keys", "b", "t"])


def _merged(batches: Iterable[pa.RecordBatch], finish: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of _SENT, those of a range and salt in one run, summed up; finish: (range, keys, b, t) -> batches."""

    def total(parts: list) -> tuple:
        return _summed(*(np.concatenate(p) for p in zip(*parts, strict=True)))

    now, parts, waiting = None, [], 0
    for batch in portions(batches, 16):
        for r, salt, k, b, t in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if now is not None and (r, salt) != now:
                yield from finish(now[0], *total(parts))
                parts, waiting = [], 0
            now = r, salt
            parts.append(_counts(k, b, t))
            waiting += len(parts[-1][0])
            if waiting > 4 * _HELD and len(parts) > 1:
                parts, waiting = [total(parts)], 0
    if now is not None:
        yield from finish(now[0], *total(parts))


def count_pairs(tokens: DataFrame, uni: Unigrams, path: str) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Write the counts of all pairs as sorted files under path; the cuts between ranges, and (range, pairs, least key) of each file, one small row a range."""
    spark, size = tokens.sparkSession, uni.size
    cuts = _ranges(uni, partitions(spark))
    salts = max(1, int(uni.contexts[0].sum() / (len(cuts) + 1) / MERGED_TOKENS))
    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % salts

        def emit(keys, b, t):
            stops = np.r_[0, np.searchsorted(keys, cuts * (size + 1)), len(keys)].tolist()
            for i, (x, y) in enumerate(zip(stops, stops[1:], strict=False)):
                yield from _rows_of(i, salt, keys[x:y], b[x:y], t[x:y])

        held = (np.zeros(0, np.int64),) * 3
        for batch in portions(batches):
            ids, owner, target = _tokens(batch)
            keys = _pairs(ids, owner, size)
            new = _summed(keys, np.ones(len(keys), np.int64), target[owner].astype(np.int64))
            held = _summed(*(np.concatenate(p) for p in zip(held, new, strict=True)))
            if len(held[0]) > _HELD:
                yield from emit(*held)
                held = (np.zeros(0, np.int64),) * 3
        yield from emit(*held)

    def write(number, keys, b, t):
        fs, folder = file_system(path)
        tag = uuid.uuid4().hex
        with fs.open_output_stream(f"{folder}/range-{number:05d}.{tag}") as f:
            f.write(keys.astype("<i8").tobytes() + b.astype("<u8").tobytes() + t.astype("<u8").tobytes())
        fs.move(f"{folder}/range-{number:05d}.{tag}", f"{folder}/range-{number:05d}")
        yield pa.RecordBatch.from_pydict({"range": pa.array([number], pa.int32()), "pairs": [len(keys)], "least": [int(keys[0])]})

    sent = tokens.select("target", "width", "ids").mapInArrow(local, _SENT)
    if salts > 1:
        parts = sent.repartition((len(cuts) + 1) * salts, "range", "salt").sortWithinPartitions("range", "salt")
        sent = parts.mapInArrow(lambda batches: _merged(batches, lambda r, *counts: _rows_of(r, 0, *counts)), _SENT)
    ranged = sent.withColumn("salt", F.lit(0)).repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range")
    found = ranged.mapInArrow(lambda batches: _merged(batches, write), "range int, pairs long, least long").collect()
    return cuts, sorted(tuple(r) for r in found)


def _views(raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of a range file of n pairs."""
    return raw[: 8 * n].view("<i8"), raw[8 * n : 16 * n].view("<u8"), raw[16 * n :].view("<u8")


def _is_local(path: str) -> bool:
    from pyarrow import fs as pafs

    return isinstance(file_system(path)[0], pafs.LocalFileSystem)


@lru_cache(2)
def _model(path: str, files: tuple) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """This worker's view of the files, which must be on a mounted file system."""
    folder = file_system(path)[1]
    return [_views(np.memmap(f"{folder}/range-{number:05d}", np.uint8, "r"), n) for number, n, _ in files]


@lru_cache(1)
def _range(path: str, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One range of the model."""
    fs, folder = file_system(path)
    with fs.open_input_file(f"{folder}/range-{number:05d}") as f:
        raw = np.frombuffer(f.read(), np.uint8)
    return _views(raw, len(raw) // 24)


def _look_up(model: list, least: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sorted keys, all of which the model has."""
    b, t = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    stops = np.r_[np.searchsorted(keys, least), len(keys)]
    for i, (k, kb, kt) in enumerate(model):
        x, y = int(stops[i]), int(stops[i + 1])
        if y > x:
            at = np.searchsorted(k, keys[x:y])
            b[x:y], t[x:y] = kb[at], kt[at]
    return b, t


def _own(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    """For each document of a batch and each pair in it: document, key, times, times of its context; and the documents' flags and tokens."""
    ids, owner, target = _tokens(batch)
    n = np.bincount(owner, minlength=len(target))
    keys = _pairs(ids, owner, size)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.nonzero(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])])[0] if len(k) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(k)])
    k, o = k[first], o[first]
    v = k // (size + 1)
    groups = np.nonzero(np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])])[0] if len(k) else first
    of_context = np.repeat(np.add.reduceat(times, groups), np.diff(np.r_[groups, len(k)])) if len(k) else times
    return o, k, times, of_context, target, n


_RESULT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _rows(doc_id: pa.Array, n: np.ndarray, background: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    each = np.maximum(n, 1)
    return pa.RecordBatch.from_arrays([doc_id, pa.array(n.astype(np.int64)), pa.array(-target / each), pa.array(-background / each), pa.array((background - target) / each)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def score(docs: DataFrame, good: DataFrame, tokenizer: str | None = None, model_pairs: int = MODEL_PAIRS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats per token) and score, their difference: low is like the target."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    size = _vocabulary(tokenizer)
    tokens = encoded(docs, good, tokenizer)
    uni = unigrams(tokens, size)
    path = shared_dir(spark, "lm-pairs")
    cuts, found = count_pairs(tokens, uni, path)
    files = tuple(found)
    shared = spark.sparkContext.broadcast(uni)  # a few numbers for each token of the vocabulary
    least = np.array([f[2] for f in files], np.int64)
    if sum(f[1] for f in files) > model_pairs or not _is_local(path):
        return _by_exchange(tokens, shared, size, path, cuts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield _scored(batch, shared.value, size, lambda distinct: _look_up(_model(path, files), least, distinct))

    return tokens.select("doc_id", "target", "width", "ids").mapInArrow(run, _RESULT)


def _scored(batch: pa.RecordBatch, uni: Unigrams, size: int, look_up: Callable) -> pa.RecordBatch:
    """Results of documents (doc_id first); look_up: sorted distinct keys -> their counts."""
    o, k, times, of_context, target, n = _own(batch, size)
    distinct, at = np.unique(k, return_inverse=True)
    b, t = look_up(distinct)
    lb, lt = uni.log_p(k, (b[at], t[at]), times, of_context, target[o])
    return _rows(batch.column(0), n, np.bincount(o, times * lb, len(n)), np.bincount(o, times * lt, len(n)))


_ASKED = "doc_id long, target boolean, block long, width int, ids binary, range int, keys binary, b binary, t binary"


def _by_exchange(tokens: DataFrame, shared, size: int, path: str, cuts: np.ndarray) -> DataFrame:
    """The same scores where no task can read the model: blocks of documents ask the ranges for the counts of their pairs."""
    spark = tokens.sparkSession
    salts = max(1, int(shared.value.contexts[0].sum() / (len(cuts) + 1) / ANSWERED_TOKENS))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Different pairs of each run of rows of a block, by range."""
        block, waiting = None, []

        def emit():
            keys = np.unique(np.concatenate(waiting))
            stops = np.r_[0, np.searchsorted(keys, cuts * (size + 1)), len(keys)].tolist()
            rows = [(i, block, np.diff(keys[x:y], prepend=0).astype("<u8").tobytes()) for i, (x, y) in enumerate(zip(stops, stops[1:], strict=False)) if y > x]
            if rows:
                r, b, k = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int64()), pa.array(k, pa.binary())], names=["range", "block", "keys"])

        for batch in portions(batches):
            blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
            stops = np.r_[0, np.nonzero(np.diff(blocks))[0] + 1, len(blocks)].tolist()
            for x, y in zip(stops, stops[1:], strict=False):
                if block is not None and blocks[x] != block:
                    yield from emit()
                    waiting = []
                block = int(blocks[x])
                ids, owner, _ = _tokens(batch.slice(x, y - x))
                waiting.append(np.unique(_pairs(ids, owner, size)))
        if waiting:
            yield from emit()

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 16):
            for r, block, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys = np.cumsum(np.frombuffer(asked, "<u8"), dtype=np.int64)
                k, b, t = _range(path, r)
                at = np.searchsorted(k, keys)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([r], pa.int32()), pa.array([asked], pa.binary()), pa.array([b[at].tobytes()], pa.binary()), pa.array([t[at].tobytes()], pa.binary())], names=["block", "range", "keys", "b", "t"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block in one run: first the answers (by range), then its documents."""
        block, parts, known = None, [], None
        for batch in portions(batches, 200):
            blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
            answers = batch.column(batch.schema.get_field_index("keys")).is_valid().to_numpy(zero_copy_only=False)
            stops = np.r_[0, np.nonzero(np.diff(blocks) | np.diff(answers.astype(np.int8)))[0] + 1, len(blocks)].tolist()
            for x, y in zip(stops, stops[1:], strict=False):
                if blocks[x] != block:
                    block, parts, known = blocks[x], [], None
                run = batch.slice(x, y - x)
                if answers[x]:
                    parts += [_counts(*c) for c in zip(*(run.column(run.schema.get_field_index(n)).to_pylist() for n in ("keys", "b", "t")), strict=True)]
                    continue
                if known is None:
                    known = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
                    known = [c[np.argsort(known[0], kind="stable")] for c in known]
                    parts = []

                def look_up(distinct, known=known):
                    at = np.searchsorted(known[0], distinct)
                    return known[1][at], known[2][at]

                yield _scored(run, shared.value, size, look_up)

    requests = tokens.select("block", "target", "width", "ids").mapInArrow(ask, "range int, block long, keys binary")
    dealt = requests.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))).repartition((len(cuts) + 1) * salts, "range", "salt").sortWithinPartitions("range")
    answers = dealt.select("range", "block", "keys").mapInArrow(answer, "block long, range int, keys binary, b binary, t binary")
    none = lambda names: [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in _ASKED.split(", ")) if n in names]
    both = tokens.select("*", *none(("range", "keys", "b", "t"))).unionByName(answers.select("*", *none(("doc_id", "target", "width", "ids"))))
    met = both.repartition(2 * partitions(spark), "block").sortWithinPartitions("block", F.col("keys").isNull(), "range")
    return met.mapInArrow(meet, _RESULT)
