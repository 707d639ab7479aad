"""SimHash near-duplicates, found by anchor-point covering.

Fingerprints have 64 bits, in blocks. Two fingerprints that differ in four bits or fewer differ in few bits of one of the
blocks: in at most one of three blocks, or two of two. The anchors of a block are the words of a covering code: a
perfect Hamming code (covering radius 1) beside the free remaining bits. A fingerprint
is at home at the anchor its block decodes to, and is replicated to each anchor which a block value within
the block's threshold decodes to, so two linked fingerprints meet at the home anchor of either. Per anchor all
members are compared on all 64 bits.

The covering is sized to the number of distinct fingerprints. Up to MANY there are three blocks and 524,288 anchors, and
a fingerprint has 41.7 rows on average; beyond, two blocks with 268,435,456 anchors and 343 rows. So an anchor has some
1,700 members with 16 million fingerprints (those of the third block half as many), and 1,280 with a billion.

Equal fingerprints are one member. An anchor with far more members than its share is split by a second covering over
bits outside its block (in some part of them the rest of the differing bits is two at most), which loses no link.

Null, blank and empty texts have fingerprint zero and are linked like any other. Very long texts are read whole, one at a
time; memory follows the longest one. Repeated rows are in one component; `one_of_each` keeps the first as written. Rows with a null key take part. Empty
tables give no rows. Columns of docs named like the operator's own are kept by `one_of_each`; `simhash_components` reads the key and text only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import map_adding, partitions, portions, small, texts_of, through, uneven_join, written

THRESHOLD = 4


class Block(NamedTuple):
    """Some bits of a fingerprint: the lowest `code` of them under a Hamming code (a power of two less one), the rest free."""

    first: int
    bits: int
    code: int
    within: int  # differing bits in which linked fingerprints meet


class Covering(NamedTuple):
    blocks: tuple[Block, ...]
    #: For each block the second covering of its crowded anchors.
    second: tuple[tuple[Block, ...], ...]

    def anchors(self) -> int:
        return sum(_anchor_count(b) for b in self.blocks)


def _anchor_count(block: Block) -> int:
    return (1 << block.bits) // (block.code + 1)


_THREE = (Block(0, 21, 15, 1), Block(21, 21, 15, 1), Block(42, 22, 15, 1))
#: One bit at most differs in the block, so of the other two one has two at most.
THREE = Covering(_THREE, tuple(tuple(b._replace(within=2) for b in _THREE if b != own) for own in _THREE))
#: The other half may have all four differing bits, so one of its quarters has two at most.
TWO = Covering((Block(0, 32, 31, 2), Block(32, 32, 31, 2)), ((Block(32, 16, 15, 2), Block(48, 16, 15, 2)), (Block(0, 16, 15, 2), Block(16, 16, 15, 2))))
#: Distinct fingerprints up to which the covering has three blocks.
MANY = 1 << 24
#: Members of an anchor beyond which it is split by a second covering, and how many times the mean they must be.
HOT_ANCHOR, HOT_TIMES = 4_000, 16
#: Parts that the members of crowded anchors are dealt to where these anchors are too many to broadcast.
SALTS = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bit i is 1 if it is set in over half the XXH64 values (seed 42) of the text's word shingles."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashed = xxhash.xxh64_intdigest
    values = np.array([hashed(s, 42) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(values)).astype("u1"), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, column: str = "_llm_fp") -> DataFrame:
    """docs plus its fingerprint as a signed long; null and blank texts have 0."""

    def add(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {column: pa.array(np.array([fingerprint(t) for t in texts_of(batch)], "<u8").view("<i8"))}

    return map_adding(docs, {column: "long"}, add)


def _syndrome(values: np.ndarray, code: int) -> np.ndarray:
    """The number of the bit to flip for a code word; 0: none."""
    out = np.zeros_like(values)
    for bit in range(code):
        out ^= (values >> bit & 1) * (bit + 1)
    return out


@cache
def _offsets(bits: int, code: int, within: int) -> list[np.ndarray]:
    """By syndrome of a value: what it differs in from each anchor that a value within so many bits decodes to; its home first."""
    flips = np.array([sum(1 << b for b in c) for k in range(within + 1) for c in combinations(range(bits), k)], np.int64)
    found = []
    for syndrome in range(code + 1):
        at = syndrome ^ _syndrome(flips, code)
        offsets = flips ^ np.where(at > 0, 1 << np.maximum(at - 1, 0), 0)
        found.append(offsets[np.sort(np.unique(offsets, return_index=True)[1])])
    return found


def anchors(values: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of one block for fingerprints (uint64): row numbers, anchors, and whether each is the row's home."""
    part = (values >> np.uint64(block.first) & np.uint64((1 << block.bits) - 1)).astype(np.int64)
    syndrome = _syndrome(part, block.code)
    offsets = _offsets(block.bits, block.code, block.within)
    rows, at, home = [], [], []
    for s in np.unique(syndrome).tolist():
        mine, o = np.nonzero(syndrome == s)[0], offsets[s]
        rows.append(np.repeat(mine, len(o)))
        at.append((part[mine][:, None] ^ o[None, :]).ravel())
        home.append(np.tile(np.arange(len(o)) == 0, len(mine)))
    if not rows:
        return part, part, part.astype(bool)
    return np.concatenate(rows), np.concatenate(at), np.concatenate(home)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of keys, so that keys of the second covering don't meet those of the first."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _at_anchors(covering: Covering):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 500):
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, block in enumerate(covering.blocks):
                rows, at, home = anchors(values, block)
                yield pa.RecordBatch.from_arrays([pa.array(at | number << 32), pa.array(values[rows].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def _at_second_anchors(covering: Covering):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2_000):
            anchor, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for own, second in enumerate(covering.second):
                use = np.nonzero(anchor >> 32 == own)[0]
                for number, block in enumerate(second if len(use) else ()):
                    rows, at, is_home = anchors(fp[use].view(np.uint64), block)
                    key = _mix(_mix(anchor[use][rows]) ^ (at | number << 40))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[use][rows]), pa.array(home[use][rows] & is_home)], names=["anchor", "fp", "home"])

    return run


class _Forest:
    """Union-find over the fingerprints of one task; keeps only links that join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        pairs = [(x, self.root(x)) for x in list(self.up)]
        return [x for x, r in pairs if x != r], [r for x, r in pairs if x != r]


def _links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, forest: _Forest, limit: int, most: int = 4_000_000) -> None:
    """Link the members of each anchor (arrays sorted by anchor): its home members against all its members."""
    starts = np.nonzero(np.r_[True, anchor[1:] != anchor[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(anchor)])
    first, count = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    left = np.nonzero(home & (count > 1))[0]
    work = np.cumsum(count[left])
    at = 0
    while at < len(left):  # blocks of so many comparisons
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + most, "right")))
        own = left[at:to]
        n = count[own]
        ends = np.cumsum(n)
        other = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first[own], n)
        x, y = fp[np.repeat(own, n)], fp[other]
        good = (np.bitwise_count(x ^ y) <= limit) & (x != y)
        for p, q in zip(x[good].view(np.int64).tolist(), y[good].view(np.int64).tolist(), strict=True):
            forest.link(p, q)
        at = to


def _compare(limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; an anchor may go on in the next batch."""
        forest, rest = _Forest(), None
        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            if rest is not None:
                now = [np.concatenate(p) for p in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                _links(*(c[:cut] for c in now), forest, limit)
            rest = [c[cut:] for c in now]
        if rest is not None:
            _links(*rest, forest, limit)
        u, v = forest.edges()
        for i in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 50_000], pa.int64()), pa.array(v[i : i + 50_000], pa.int64())], names=["u", "v"])

    return run


def links(fingerprints: DataFrame, threshold: int = THRESHOLD, covering: Covering | None = None, hot: int | None = None) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp, long; written), enough to join all that are reachable.

    Each task emits a forest, not all pairs. threshold: 4 at most, as the blocks are made for it. covering and hot (members
    of a crowded anchor): by the number of fingerprints unless given.
    """
    if threshold > THRESHOLD:
        raise ValueError(f"the covering serves thresholds up to {THRESHOLD}")
    spark = fingerprints.sparkSession
    count = fingerprints.count()
    covering = covering or (THREE if count <= MANY else TWO)
    mean = count * sum(len(_offsets(*b[1:])[0]) for b in covering.blocks) / covering.anchors()
    hot = hot or max(HOT_ANCHOR, int(HOT_TIMES * mean))
    schema = "anchor long, fp long, home boolean"
    members = fingerprints.select("fp").mapInArrow(_at_anchors(covering), schema)
    crowded = written(members.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor"), "hot-anchors")
    if not crowded.isEmpty():
        # the flag must not bring an anchor's members together: crowded anchors are broadcast if few, else each is dealt to SALTS parts
        flag, key = small(crowded), ["anchor"]
        if flag is crowded:
            flag, key = crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["anchor", "salt"]
            members = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
        split = members.join(flag, key, "left_semi").select("anchor", "fp", "home").mapInArrow(_at_second_anchors(covering), schema)
        members = members.join(flag, key, "left_anti").select("anchor", "fp", "home").unionByName(split)
    return members.repartition(2 * partitions(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(_compare(threshold), "u long, v long")


def near_duplicates(marked: DataFrame, fp: str = "_llm_fp", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """marked (written, with a fingerprint column) plus component_id, the smallest key reachable over links.

    Rows with a null key take part and get their component's smallest non-null key (null if there is none).
    Repeated rows are in one component. An empty table gives no rows. Neither a fingerprint that very many rows have nor a
    component of very many fingerprints meets in one task.
    """
    unique = written(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least"), F.count("*").alias("rows")), "fingerprints")
    roots = written(components(links(unique, threshold)), "components")
    known = written(unique.join(roots, unique.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "roots")
    lowest = written(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "lowest")
    prints, rows = known.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    named = uneven_join(known, lowest, "root", "n", prints).select(F.col("fp").alias(fp), "component_id", "rows")
    return uneven_join(marked.drop("component_id"), written(named, "component-ids"), fp, "rows", rows)


def simhash_components(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of every document."""
    marked = written(with_fingerprint(docs.select(key, "text")).drop("text"), "simhash")
    return near_duplicates(marked, key=key).select(key, F.lpad(F.lower(F.hex("_llm_fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id (null last), the first such row as written."""
    return through(docs, _one_of_each)


def _one_of_each(docs: DataFrame) -> DataFrame:
    marked = written(with_fingerprint(docs).withColumn("_llm_row", F.monotonically_increasing_id()), "simhash-docs")
    narrow = marked.select("doc_id", "_llm_row", "_llm_fp")
    grouped = near_duplicates(narrow.withColumn("_llm_key", F.col("_llm_row")), key="_llm_key").select("doc_id", "_llm_row", F.col("component_id").alias("_llm_group"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_llm_row"))
    stays = grouped.groupBy("_llm_group").agg(first.alias("first")).select(F.col("first._llm_row").alias("_llm_row"))
    return marked.join(stays, "_llm_row", "left_semi")
