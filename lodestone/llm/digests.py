"""Improbable-feature digests of byte strings.

A feature is a window of WINDOW bytes. Its entropy level follows from how often each byte occurs in it; how rare a
level is, the counts of all windows of the whole corpus tell (`rarity`, a histogram of LEVELS numbers). Every run of
NEIGHBOURS windows votes for its rarest one (the first of equals); windows with at least VOTES votes are the features.
Where a text repeats itself, votes go to equal windows at many places: these are added up, and the first place is the
feature. A text that still has none has all its different windows as features, so only the empty text has no digest.
A feature sets HASHES bits of a Bloom filter of BITS bits; after FEATURES features the next filter of the chain begins.

Two filters are as alike as their common bits exceed those expected by chance, over the most they could have in common.
Two digests are as alike as the mean, over the filters of the shorter chain by their bits, of the best match in the
other chain.

A text of fewer than SHORT bytes has all its windows of SHORT_WINDOW bytes as features (one of fewer bytes: itself).
The empty text has the empty digest, which is like itself only.

Long texts are worked on in overlapping stretches of STRETCH windows and chains are compared in blocks, so that memory is a few times
the longest text; results are those of the whole. Null text is empty. Of windows equally rare the first has the vote. Documents follow each
other by doc_id, null first; rows of one id by text (of an id so common that it is split into ranges, by a hash of the text first); repeated rows are separate documents with equal fingerprints. An
empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ARROW_ROWS, groups, partitions, portions, tie

WINDOW, NEIGHBOURS, VOTES = 32, 32, 8
BITS, HASHES, FEATURES = 2048, 5, 160
SHORT, SHORT_WINDOW = 64, 8
#: Level: the whole part of 2 x the sum of n log2 n over the bytes of a window, 0 (all differ) to 320 (all equal).
LEVELS = 2 * WINDOW * 5 + 1
#: Windows of so few different bytes tell nothing, however rare they are.
_DULL = 2 * 96
#: Windows that are worked on at once.
STRETCH = 1 << 19
_SCALE = 1 << 16
_N = np.arange(WINDOW + 2)
_G = np.round(_SCALE * 2 * _N * np.log2(np.maximum(_N, 1))).astype(np.int64)
_STEP = np.diff(_G)  # from n to n + 1


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of each window of a byte array (len(data) - WINDOW + 1 of them)."""
    n = len(data)
    after, before = np.ones(n, np.uint8), np.ones(n, np.uint8)  # equal bytes in the window from, or up to, a place
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        after[:-k] += same
        before[k:] += same
    windows = n - WINDOW + 1
    first = _G[np.bincount(data[:WINDOW], minlength=256)].sum()
    # from window t to t + 1: one byte less of the first, one more of the new
    gone = _STEP[after[: windows - 1] - 1]
    new = before[WINDOW:].astype(np.int64)
    come = _STEP[new - 1]
    total = np.empty(windows, np.int64)
    total[0] = first
    np.cumsum(come - gone, out=total[1:])
    total[1:] += first
    return (total // _SCALE).astype(np.int64)


def rank(rarity: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first; levels of dull windows come last."""
    order = np.lexsort((np.arange(LEVELS), rarity, np.arange(LEVELS) >= _DULL))
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    return out


def _join(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array, and where each begins and ends."""
    ends = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(r) for r in raw]), ends


def _hash(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a matrix of bytes (a multiple of eight wide)."""
    h = np.full(len(windows), 0x9E3779B97F4A7C15, np.uint64)
    for column in np.ascontiguousarray(windows).view("<u8").T:
        h = (h ^ column) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _stretches(length: int) -> list[tuple[int, int]]:
    """Ranges of the windows of a text of so many bytes."""
    n = length - WINDOW + 1
    return [(a, min(n, a + STRETCH)) for a in range(0, max(n, 0), STRETCH)]


def _votes(raw: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owner (index in raw), place, votes and hash of the windows that have votes; raw: texts of SHORT bytes or more."""
    found, waiting, held = [], [], 0
    for i, r in enumerate(raw):
        for lo, hi in _stretches(len(r)):
            waiting.append((i, lo, hi))
            held += hi - lo
            if held >= STRETCH:
                found.append(_votes_of(raw, waiting, ranks))
                waiting, held = [], 0
    if waiting:
        found.append(_votes_of(raw, waiting, ranks))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _votes_of(raw: list[bytes], parts: list[tuple[int, int, int]], ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """_votes for some stretches (text, first window, last but one), each read with the neighbours that its runs reach."""
    text, lo, hi = (np.array(c, np.int64) for c in zip(*parts, strict=True))
    last = np.array([len(raw[i]) - WINDOW + 1 for i in text.tolist()])
    begin, stop = np.maximum(lo - NEIGHBOURS + 1, 0), np.minimum(hi + NEIGHBOURS - 1, last)
    data, starts, ends = _join([raw[i][a : b + WINDOW - 1] for i, a, b in zip(text.tolist(), begin.tolist(), stop.tolist(), strict=True)])
    level = levels(data)
    position = np.arange(len(level))
    owner = np.searchsorted(ends, position, "right")
    inside = position + WINDOW <= ends[owner]
    far = np.int64(1) << 62
    # windows of the own stretch are less than those of the next one, so runs end where a stretch ends
    key = np.where(inside, owner << 40 | ranks[level] << 31 | position, far)
    least = np.concatenate([key, np.full(NEIGHBOURS, far)])
    width = 1
    while width < NEIGHBOURS:  # least of 2, 4, 8, ... neighbours
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    window = position - starts[owner] + begin[owner]
    runs = inside & (window < hi[owner])
    votes = np.bincount(least[: len(key)][runs] & (1 << 31) - 1, minlength=len(key))
    at = np.nonzero((votes > 0) & (window >= lo[owner]) & (window < hi[owner]))[0]
    return text[owner[at]], window[at], votes[at], _hash(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at])


def _features(raw: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner (index in raw, ascending) and hash of every feature in order of place; raw: texts of SHORT bytes or more."""
    owner, place, votes, hashed = _votes(raw, ranks)
    order = np.lexsort((place, hashed, owner))
    same = np.r_[True, (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
    first = np.nonzero(same)[0]
    n = votes[order]
    # equal windows that have the votes only together count at their first place
    together = order[first[(np.add.reduceat(n, first) >= VOTES) & (np.maximum.reduceat(n, first) < VOTES)]]
    picked = np.union1d(np.nonzero(votes >= VOTES)[0], together)
    owners, places, hashes = [owner[picked]], [place[picked]], [hashed[picked]]
    for i in np.setdiff1d(np.arange(len(raw)), owner[picked]).tolist():
        h, at = _different(raw[i])
        owners.append(np.full(len(h), i))
        places.append(at)
        hashes.append(h)
    owner, place, hashed = (np.concatenate(c) for c in (owners, places, hashes))
    order = np.lexsort((place, owner))
    return owner[order], hashed[order]


def _different(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different windows of a text, and the first place of each."""
    hashed, place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for a, b in _stretches(len(text)):
        new = _hash(np.lib.stride_tricks.sliding_window_view(np.frombuffer(text[a : b + WINDOW - 1], np.uint8), WINDOW))
        hashed, at = np.unique(np.concatenate([hashed, new]), return_index=True)
        place = np.concatenate([place, np.arange(a, b)])[at]
    return hashed, place


def _short_features(text: bytes) -> np.ndarray:
    if len(text) < SHORT_WINDOW:
        text = text.ljust(SHORT_WINDOW, b"\0")
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), SHORT_WINDOW)
    return _hash(windows) ^ np.uint64(0xA5A5A5A5A5A5A5A5)


def digest(raw: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The chain of filters (k x BITS / 8 bytes) of each text."""
    long = [i for i, r in enumerate(raw) if len(r) >= SHORT]
    owners, hashes = [], []
    if long:
        o, h = _features([raw[i] for i in long], ranks)
        owners.append(np.array(long)[o])
        hashes.append(h)
    for i, r in enumerate(raw):
        if 0 < len(r) < SHORT:
            h = _short_features(r)
            owners.append(np.full(len(h), i))
            hashes.append(h)
    out = [np.zeros((0, BITS // 8), np.uint8)] * len(raw)
    if not owners:
        return out
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    owner, hashed = owner[order], hashed[order]
    first = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
    count = np.diff(np.r_[first, len(owner)])
    chains = -(-count // FEATURES)
    base = np.cumsum(chains) - chains
    place = np.repeat(base, count) + (np.arange(len(owner)) - np.repeat(first, count)) // FEATURES
    bits = np.zeros((int(chains.sum()), BITS), bool)
    for i in range(HASHES):
        bits[place, (hashed >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    for i, b, c in zip(owner[first].tolist(), base.tolist(), chains.tolist(), strict=True):
        out[i] = packed[b : b + c]
    return out


def likeness(a: np.ndarray, b: np.ndarray, block: int = 64, other: int = 1024) -> float:
    """How alike two chains are, 0 to 1. So many filters of the shorter and of the longer one are compared at once."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    a8, b8 = a.view(np.uint64), b.view(np.uint64)
    of_a, of_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a8, b8))
    best = np.zeros(len(a))
    for i in range(0, len(a), block):
        x = of_a[i : i + block, None]
        for j in range(0, len(b), other):
            y = of_b[None, j : j + other]
            common = np.bitwise_count(a8[i : i + block, None, :] & b8[None, j : j + other, :]).sum(2, dtype=np.int64)
            most, chance = np.minimum(x, y), x * y / BITS
            score = np.where(common >= most, 1.0, np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1))
            best[i : i + block] = np.maximum(best[i : i + block], score.max(1))
    return float((best * of_a).sum() / of_a.sum())


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def rarity(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts of docs have each level: LEVELS numbers, summed up by Spark."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in portions(batches):
            for raw in groups(_pieces(batch.column(0).to_pylist()), ARROW_ROWS, 1 << 18):
                data, _, ends = _join(raw)
                level = levels(data)
                position = np.arange(len(level))
                total += np.bincount(level[position + WINDOW <= ends[np.searchsorted(ends, position, "right")]], minlength=LEVELS)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["level", "n"])

    out = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def _pieces(texts: list[str | None]) -> Iterator[bytes]:
    """The texts that have windows, in stretches that have each window once."""
    for t in texts:
        raw = _raw(t or "")
        for a, b in _stretches(len(raw)):
            yield raw[a : b + WINDOW - 1]


def _text_of(chain: np.ndarray) -> str:
    return "".join(f"{row.tobytes().hex()}" for row in chain)


def edited(text: str, following: str) -> str:
    """text whose last quarter (floor) is replaced by as much of the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k] if k else text


#: The key of null ids; as the least long has no literal, it is the one above.
_LEAST = -(1 << 63) + 1


def _key() -> Column:
    """doc_id, null as the least."""
    return F.greatest(F.col("doc_id").cast("long"), F.lit(_LEAST))


#: All values of tie() are below this.
_TIES = 1 << 20


def _bounds(quantiles: list[int]) -> list[tuple[int, int]]:
    """Ends of ranges (key, tie) from quantiles of the key; one that comes several times has its rows split by tie."""
    out = set()
    for v, n in Counter(quantiles).items():
        out.add((v, _TIES - 1))
        if n > 1:
            out.add((max(v - 1, _LEAST), _TIES - 1))
            out |= {(v, j * _TIES // n - 1) for j in range(1, n)}
    return sorted(out)


def _place(docs: DataFrame, bounds: list[tuple[int, int]], least: dict[int, tuple[int, int]] | None = None):
    """A function of the columns key and tie: bucket (range i holds what comes up to bounds[i]), the used bucket before it, and whether the row is its least.

    Bounds travel as one sorted array, so a plan has the same size for any number of ranges. least: bucket -> its least key and tie.
    """
    kind = [("key", "<i8"), ("tie", "<i8")]
    used = sorted(least or {})
    firsts, before = np.array([(_LEAST, -1)] * (len(bounds) + 1), kind), np.zeros(len(bounds) + 1, np.int32)
    for i, b in enumerate(used):
        firsts[b], before[b] = least[b], used[i - 1]
    shared = docs.sparkSession.sparkContext.broadcast((np.array(bounds, kind), firsts, before))  # a few numbers for each range

    @F.pandas_udf("bucket int, before int, first boolean")
    def place(key: pd.Series, tied: pd.Series) -> pd.DataFrame:
        ends, firsts, before = shared.value
        row = np.empty(len(key), kind)
        row["key"], row["tie"] = key, tied
        bucket = np.searchsorted(ends, row).astype(np.int32)
        return pd.DataFrame({"bucket": bucket, "before": before[bucket], "first": row == firsts[bucket]})

    return place


def in_order(docs: DataFrame, count: int | None = None) -> DataFrame:
    """bucket, last, doc_id, text: docs in ranges of doc_id, one range to a partition, sorted (null ids first; equal ids by text, those of an id that is split by its tie first).

    A range ends with the rows that begin the next range, marked last (the final range with those of the first),
    so that each row of a range is followed by the row that follows it in the whole table. An id that many rows have is split.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", _key())
    count = count or 2 * partitions(docs.sparkSession)
    quantiles = rows.agg(F.percentile_approx("key", [i / count for i in range(1, count)], max(10_000, 10 * count))).first()[0] or []
    bounds = _bounds(quantiles)
    common = [v for v, n in Counter(quantiles).items() if n > 1]  # ids that many rows have; only for these the text is hashed
    rows = rows.withColumn("tie", F.when(F.col("key").isin(common), tie()).otherwise(0) if common else F.lit(0).cast("long"))
    # one row for each range: its least key and tie
    firsts = rows.select("key", "tie").withColumn("bucket", _place(docs, bounds)("key", "tie")["bucket"]).groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("f")).select("bucket", "f.*").collect()
    placed = rows.withColumn("at", _place(docs, bounds, {r["bucket"]: (r["key"], r["tie"]) for r in firsts})("key", "tie"))
    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("last"))
    extra = F.struct(F.col("at.before").alias("bucket"), F.lit(True).alias("last"))
    to = F.when(F.col("at.first"), F.array(own, extra)).otherwise(F.array(own))
    dealt = placed.select(F.explode(to).alias("to"), "key", "tie", "doc_id", "text").select("to.bucket", "to.last", "key", "tie", "doc_id", "text")
    return dealt.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "last", "key", "tie", "text").drop("key", "tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    Null texts are empty. Documents follow each other by doc_id; repeated rows are separate documents.
    """
    ranks = rank(rarity(docs))

    def finish(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of all but the last text."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        chains = digest([_raw(t) for t in texts], ranks)
        others = digest([_raw(t) for t in changed], ranks)
        n = len(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:n], pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array(changed, pa.string()),
                pa.array([_text_of(c) for c in chains[:n]], pa.string()),
                pa.array([_text_of(c) for c in others], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(chains, others, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(chains, chains[1:], strict=False)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, ended = [], [], 0, None
        for batch in portions(batches):
            for bucket, last, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("bucket", "last", "doc_id", "text")), strict=True):
                if ended == bucket:  # more rows of the next range's least doc_id
                    continue
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if last:
                    ended = bucket
                if len(texts) > 1 and (last or held >= 1 << 17):
                    yield finish(ids, texts)
                    ids, texts, held = ([], [], 0) if last else (ids[-1:], texts[-1:], len(texts[-1]))

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
