"""Packing documents into training sequences whose sources keep target token proportions.

Documents are encoded and dealt into parts of bounded size, by a plan of how long the sources last: all sources are used in
proportion to their targets until the scarcest one ends, then the others in proportion to theirs, and so on (`Plan`). A document's
place in its source follows from a hash, and its part from the place, so a part holds the tokens which the plan has for it, but for
chance. A part has a queue of documents for each source.

Deficit round-robin fills its windows of CONTEXT tokens: for each window every source's deficit grows by its planned
share of the window, then sources are served in turn from the heads of their queues as far as their deficits go,
documents being cut where a window or a deficit ends; what is left of a window goes to the sources with the largest
deficits. Deficits are carried from window to window, and from part to part: a part starts with the deficits at which
the parts before it end, which follow from plan and tokens by prefix sums, and makes them good evenly over its windows.

Windows are full except where a part ends: its rest is cut into sequences of 1024, 512, ... tokens, powers of two,
so there is no padding at all. No token is dropped; a source whose queue is empty leaves its share to the others.

Null text is empty (the end id only); a null source is "". Repeated rows are separate documents. A very long text is encoded whole and lies in the
part where it begins, so memory follows the longest one. Between equal deficits the first source by name is served. An empty
table gives no rows. Other columns than doc_id, text and source are not read, so their names don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder, tokenizer_path
from .mixing import TEMPER
from .shared import partitions, portions, prefix_sums, small, written

CONTEXT = 2048
#: A source is served once its deficit has reached so many tokens (or all that it has left).
GRANULE = 128
#: Tokens in a part, about; bounds a task's memory.
PART_TOKENS = 6_000_000
#: Tasks up to which each packs one part; and the parts that a task packs one after the other where there are very many.
TASKS, PARTS_A_TASK = 10_000, 32
#: Stretches of a source, for each part, in which its tokens are counted.
BINS = 4
#: Sources last for times that are told apart in so many steps for each doubling; bounds the plan.
STEPS = 32
_DEALS = 1 << 31


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, source, n, deal (a hash) and ids (unsigned, as narrow as the vocabulary allows) of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, seen, task = encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in portions(batches):
            ids = [raw + end for raw in enc.raw([x or "" for x in batch.column(1).to_pylist()])]
            deal = []
            for k, raw in zip(batch.column(0).to_pylist(), ids, strict=True):
                h = zlib.crc32(str(k).encode(), zlib.crc32(raw))
                again = seen[h] and seen[h] * 0x9E3779B1 + task  # repeated rows go to different parts
                deal.append((h * 2_654_435_761 + again) % _DEALS)
                seen[h] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(deal, pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "deal", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    return rows.mapInArrow(run, "doc_id long, source string, n long, deal long, width int, ids binary")


class Plan:
    """When the sources are used: at time t a source has given weight x t tokens, until it ends."""

    def __init__(self, lasts: np.ndarray, weights: np.ndarray):
        """lasts: tokens over weight, of groups of sources; weights: of the groups."""
        order = np.argsort(lasts)
        lasts, weights = lasts[order], weights[order]
        left = weights.sum() - np.r_[0.0, np.cumsum(weights)[:-1]]  # weight of the groups that last at least as long
        self.time = np.r_[0.0, lasts]
        self.tokens = np.r_[0.0, np.cumsum(np.diff(self.time) * left)]

    def tokens_at(self, time: np.ndarray) -> np.ndarray:
        return np.interp(time, self.time, self.tokens)

    def time_at(self, tokens: np.ndarray) -> np.ndarray:
        return np.interp(tokens, self.tokens, self.time)


class _Part:
    """One part's queues and deficits."""

    def __init__(self, number: int):
        self.number, self.queues, self.left = number, {}, {}
        self.deficit: dict[str, float] = {}
        self.weight: dict[str, float] = {}

    def add(self, source: str, doc_id: int | None, ids: np.ndarray) -> None:
        self.queues.setdefault(source, deque()).append([doc_id, ids, 0])
        self.left[source] = self.left.get(source, 0) + len(ids)

    def _take(self, source: str, most: int, out: list, offset: int) -> int:
        """Move up to so many tokens from a queue to a window at an offset; returns how many."""
        queue, taken = self.queues[source], 0
        while taken < most:
            head = queue[0]
            n = min(most - taken, len(head[1]) - head[2])
            out.append((head[0], head[2], n, head[1], offset + taken, source))
            head[2] += n
            taken += n
            if head[2] == len(head[1]):
                queue.popleft()
        self.left[source] -= taken
        self.deficit[source] -= taken
        return taken

    def windows(self, context: int, granule: int) -> Iterator[list]:
        """Lists of (doc_id, start, length, ids of the document, offset, source)."""
        names = sorted(self.queues)
        whole = sum(self.weight.get(s, 0.0) for s in names) or 1.0
        for s in names:
            self.deficit.setdefault(s, 0.0)
            self.weight[s] = self.weight.get(s, 0.0) / whole
        rest, turn = sum(self.left.values()), 0
        # what was carried here is made good evenly over the part, so that no window is far from the targets
        carried = {s: self.deficit[s] / max(1, rest) for s in names}
        self.deficit = dict.fromkeys(names, 0.0)
        while rest:
            size = context if rest >= context else 1 << rest.bit_length() - 1
            window, filled = [], 0
            for s in names:
                self.deficit[s] += (self.weight[s] + carried[s]) * size
            for i in range(len(names)):
                s = names[(i + turn) % len(names)]
                due, left = int(self.deficit[s]), self.left[s]
                if left and due >= min(granule, left) and filled < size:
                    filled += self._take(s, min(due, left, size - filled), window, filled)
            while filled < size:
                s = max((s for s in names if self.left[s]), key=lambda s: self.deficit[s])
                filled += self._take(s, min(max(granule, int(self.deficit[s])), self.left[s], size - filled), window, filled)
            names_left = [s for s in names if self.left[s]]
            turn = (turn + 1) % max(1, len(names_left))
            names = names_left
            rest -= size
            yield window


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string, target_share double, window_share double"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def _packed(context: int, granule: int):
    def emit(part: _Part) -> Iterator[pa.RecordBatch]:
        windows, numbers = [], []
        for k, window in enumerate(part.windows(context, granule)):
            windows += window
            numbers += [k] * len(window)
            if len(windows) >= 10_000:
                yield batch_of(part, windows, numbers)
                windows, numbers = [], []
        if windows:
            yield batch_of(part, windows, numbers)

    def batch_of(part: _Part, pieces: list[tuple], numbers: list[int]) -> pa.RecordBatch:
        doc_id, start, length, ids, offset, source = zip(*pieces, strict=True)
        code = {s: i for i, s in enumerate(part.weight)}
        first, n = np.array(numbers), np.array(length)
        first -= first[0]
        sources = np.array([code[s] for s in source])
        held = np.zeros((first[-1] + 1, len(code)), np.int64)
        np.add.at(held, (first, sources), n)
        raw = [x[a : a + k].astype("<u4").tobytes() for x, a, k in zip(ids, start, length, strict=True)]
        targets = np.array([part.weight[s] for s in code])
        columns = [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n), pa.array(raw, pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array(np.array(numbers) | part.number << 32), pa.array(offset, pa.int64()), pa.array(source, pa.string()), pa.array(targets[sources]), pa.array(held[first, sources] / held.sum(1)[first])]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: _Part | None = None
        for batch in portions(batches):
            for number, source, weight, deficit, doc_id, width, ids in zip(*(batch.column(n).to_pylist() for n in ("part", "source", "weight", "deficit", "doc_id", "width", "ids")), strict=True):
                if part is None or part.number != number:
                    if part is not None:
                        yield from emit(part)
                    part = _Part(number)
                if ids is None:
                    part.weight[source], part.deficit[source] = weight, deficit
                else:
                    part.add(source, doc_id, np.frombuffer(ids, f"<u{width}"))
        if part is not None:
            yield from emit(part)

    return run


def targets(tokens: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """source, held (its tokens), weight (its target) and lasts (held over weight), written.

    weights: relative target token shares by source; None: held ** TEMPER, as in `mixing`. A source without a weight comes last: it has a
    millionth of its actual share.
    """
    sizes = tokens.groupBy("source").agg(F.sum("n").cast("double").alias("held"))
    if weights is None:
        weight = F.pow("held", F.lit(TEMPER))
    else:
        given = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))[F.col("source")] if weights else F.lit(None).cast("double")
        weight = F.coalesce(given, F.lit(0.0))
    sized = written(sizes.withColumn("wanted", weight), "packing-sources")
    wanted, held = sized.agg(F.sum("wanted"), F.sum("held")).first()  # two numbers
    share = F.greatest(F.col("wanted") / (wanted or 1.0), F.col("held") * (1e-6 / (held or 1.0)))
    return sized.select("source", "held", share.alias("weight"), (F.col("held") / share).alias("lasts"))


def pack(docs: DataFrame, weights: dict[str, float] | None = None, tokenizer: str | None = None, end_id: int = 1, context: int = CONTEXT, granule: int = GRANULE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    source, target_share (what the plan has for its source in this part) and window_share (what the sequence has of it).

    weights: relative target token shares by source (a source not named: 0); None: tokens ** TEMPER, which raises small sources.
    """
    spark = docs.sparkSession
    tokens = written(encoded(docs, tokenizer or tokenizer_path(), end_id), "packing-tokens")
    total = tokens.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], _PIECES)
    count = max(partitions(spark), -(-total // PART_TOKENS))
    sources = targets(tokens, weights)
    # groups of sources that last about equally long, STEPS for each doubling
    grouped = sources.groupBy(F.floor(F.log2("lasts") * STEPS).alias("g")).agg(F.sum("held").alias("held"), F.sum("weight").alias("weight")).collect()
    plan = Plan(np.array([g["held"] / g["weight"] for g in grouped]), np.array([g["weight"] for g in grouped]))
    part_tokens = plan.tokens[-1] / count

    @F.pandas_udf("int")
    def part_at(time: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(plan.tokens_at(time.to_numpy()) / part_tokens, count - 1).astype(np.int32))

    @F.pandas_udf("double")
    def begins(part: pd.Series) -> pd.Series:
        return pd.Series(plan.time_at(part.to_numpy() * part_tokens))

    # a document's place in its source: the tokens of the stretches before its own, and its share of this one
    bins = BINS * count
    place = F.col("deal") * (bins / _DEALS)
    binned = tokens.withColumn("bin", F.floor(place)).withColumn("rest", place - F.floor(place))
    stretches = prefix_sums(binned.groupBy("source", "bin").agg(F.sum("n").cast("double").alias("in_bin")), ["source"], "bin", "in_bin", "before")
    timed = stretches.join(small(sources.select("source", "weight")), "source").select("source", "bin", (F.col("before") / F.col("weight")).alias("begin"), (F.col("in_bin") / F.col("weight")).alias("span"))
    parted = binned.join(small(written(timed, "packing-bins")), ["source", "bin"]).withColumn("part", part_at(F.col("begin") + F.col("rest") * F.col("span")))
    parted = parted.select("part", "deal", "source", "n", "doc_id", "width", "ids")
    # per part and source: what the plan has for it, and what it has lagged behind in the parts before
    held = written(parted.groupBy("part", "source").agg(F.sum("n").cast("double").alias("held")), "packing-totals")
    known = prefix_sums(held, ["source"], "part", "held", "own").join(small(sources.select("source", "weight", "lasts")), "source")
    until = lambda time: F.col("weight") * F.least(time, F.col("lasts"))
    first, last = until(begins("part")), until(begins(F.col("part") + 1))
    heads = known.select("part", F.lit(-1).cast("long").alias("deal"), "source", ((last - first) / part_tokens).alias("weight"), (first - F.col("own")).alias("deficit"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("binary").alias("ids"))
    body = parted.select("part", "deal", "source", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("deficit"), "doc_id", "width", "ids")
    tasks = min(count, max(TASKS, -(-count // PARTS_A_TASK)))
    dealt = heads.unionByName(body).repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "deal", "doc_id")
    return dealt.mapInArrow(_packed(context, granule), _PIECES)
