"""Embedding whitening by block subspace iteration that never forms the covariance.

Entries become whole numbers, x = floor(64 c) + 1000000, so counts and sums are exact. The vectors that are usable are written once, as matrices of
some thousand rows in the narrowest integer type. Each pass multiplies: every task centres its rows, computes the products
X'(X Q) for the block Q of at most d x (k + OVERSAMPLE) numbers, and adds them up; its one matrix goes to SLOTS sums
and these to the driver. The driver orthonormalises (QR) and takes Ritz pairs in the span of all blocks so far; the next block is
their residuals. It ends when the residuals of all k pairs are below TOLERANCE of the largest eigenvalue. Since blocks are orthogonal to
those before, they span everything after d / block passes at the latest, where the pairs are exact: near-equal eigenvalues cost no more passes than that.

Vectors that are null or hold null, NaN or infinite entries are dropped, as the contract says; so are empty ones and those not of the commonest
length (of equally common ones the longest), which have no covariance with the others. Repeated rows count each time, a null vec_id comes through. Directions without variance
(eigenvalue at most RANK of the largest) can't be whitened and give no rows: few rows or equal ones give fewer components than k, an empty table no rows at all.
Entries beyond 2^46 count as that. A deviation beyond 64 bits is the largest long. Memory follows the length of a vector, not their number. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import portions, written

COMPONENTS, OVERSAMPLE = 32, 8
#: Largest residual of a certified pair, and smallest eigenvalue of a direction, as parts of the largest eigenvalue.
TOLERANCE, RANK = 1e-13, 1e-12
#: Fixed values of the whole numbers.
SCALE, SHIFT = 64, 1_000_000
#: Rows of a written matrix (fewer where vectors are long), and sums that tasks add up to.
ROWS, NUMBERS, SLOTS = 4096, 1 << 20, 64
_LARGEST = 2**63 - 1


@dataclass
class Whitening:
    """values: falling eigenvalues; vectors: d x k, unit columns; sums: of the numbers x - SHIFT; residual: the largest of the pairs."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and vector (array<double>) of the rows that can be used."""
    finite = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0]["d"] if lengths else 0))


def _packed(rows: DataFrame) -> DataFrame:
    """Matrices of whole numbers: keys, width, kind (its numpy type), x (row by row), sums."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = len(batch.column(1)[0])
            for part in portions([batch], max(1, min(ROWS, NUMBERS // width))):
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                x = np.clip(np.floor(SCALE * np.clip(flat, -(2.0**47), 2.0**47)), -(2.0**52), 2.0**52).astype(np.int64).reshape(-1, width)
                kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
                sums = [sum(map(int, c)) for c in x.T] if kind == "<i8" else x.sum(0).tolist()
                row = {"keys": [part.column(0).to_pylist()], "width": [width], "kind": [kind], "x": [x.astype(kind).tobytes()], "sums": [[str(s) for s in sums]]}
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.list_(part.schema.field(0).type)), pa.array(row["width"], pa.int32()), *(pa.array(row[c]) for c in ("kind", "x")), pa.array(row["sums"], pa.list_(pa.string()))], names=list(row))

    kind = rows.schema["key"].dataType.simpleString()
    return written(rows.mapInArrow(pack, f"keys array<{kind}>, width int, kind string, x binary, sums array<string>"), "whitening-rows")


class _Centre:
    """x minus its mean, to double precision: the mean's whole part is taken off as a whole number."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, x: np.ndarray, centred: np.ndarray) -> list[int]:
        """Sums of (n x - S)^2, exact. 64-bit arithmetic wraps, which leaves results right that fit; a float says which do."""
        with np.errstate(over="ignore"):
            wrap = lambda v: np.array([int(s) & (2**64 - 1) for s in v], np.uint64)
            t = x.astype(np.int64).view(np.uint64) * np.uint64(self.n) - wrap(self.sums)
            exact = (t * t).sum(1)
        about = (centred * centred).sum(1) * float(self.n) ** 2
        out = exact.tolist()
        for i in np.flatnonzero(about > 0.999 * _LARGEST):
            out[i] = _LARGEST if about[i] > 1.001 * _LARGEST else min(_LARGEST, sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums, strict=True)))
        return out


def _matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("x", "kind", "width")]
    for x, kind, width in zip(*columns, strict=True):
        yield np.frombuffer(x.as_py(), kind.as_py()).reshape(-1, width.as_py()).astype(np.int64)


def _added(packed: DataFrame, size: int, function) -> np.ndarray:
    """The sum over all matrices of function (matrix -> `size` numbers): within tasks, then in SLOTS groups, then here.

    Parts are added in the order of the tasks, so a repeated run gives the same bits.
    """

    def within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in _matrices(batch):
                total += function(x)
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([at % SLOTS], pa.int32()), pa.array([at], pa.int32()), pa.array([total.tobytes()])], names=["slot", "at", "part"])

    def add(parts: pa.Table) -> pa.Table:
        parts, total = parts.sort_by("at"), np.zeros(size)
        for p in parts["part"]:
            total += np.frombuffer(p.as_py())
        return pa.table({"slot": parts["slot"][:1], "part": pa.array([total.tobytes()])})

    parts = packed.select("x", "kind", "width").mapInArrow(within, "slot int, at int, part binary")
    slots = parts.groupBy("slot").applyInArrow(add, "slot int, part binary").collect()  # at most SLOTS matrices of the block's size
    return sum((np.frombuffer(bytes(r["part"])) for r in sorted(slots)), np.zeros(size))


def _orthonormal(new: np.ndarray, basis: np.ndarray, wanted: int, rng: np.random.Generator) -> np.ndarray:
    """`wanted` unit columns orthogonal to basis and each other, from those of new as far as these say anything, else random ones."""
    found = np.zeros((len(basis), 0))
    for column in (*new.T, *rng.standard_normal((2 * wanted + 4, len(basis)))):
        if found.shape[1] == wanted:
            break
        size = np.linalg.norm(column)
        if size == 0:
            continue
        column = column / size
        for _ in range(3):
            for known in (basis, found):
                column = column - known @ (known.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-8:
            column = column / left
            for known in (basis, found):
                column = column - known @ (known.T @ column)
            found = np.column_stack([found, column / np.linalg.norm(column)])
    return found


def _fit(packed: DataFrame, components: int, tolerance: float, seed: int = 7) -> Whitening | None:
    totals = packed.select(F.size("keys").alias("rows"), F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("rows").alias("n")).orderBy("at").collect()
    if not totals:
        return None
    n, sums, d = totals[0]["n"], [int(r["s"]) for r in totals], len(totals)
    k, block, centre, rng = min(components, d), min(components + OVERSAMPLE, d), _Centre(n, sums), np.random.default_rng(seed)
    basis, image, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0
    new = rng.standard_normal((d, block))
    while True:
        q = _orthonormal(new, basis, min(block, d - basis.shape[1]), rng)

        def products(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = centre(x)
            return np.append((c.T @ (c @ q)).ravel(), (c * c).sum())

        total, passes = _added(packed, q.size + 1, products) / n, passes + 1
        basis, image = np.column_stack([basis, q]), np.column_stack([image, total[:-1].reshape(q.shape)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, : max(k, block)]
        residuals = image @ turn[:, : max(k, block)] - ritz * values[: max(k, block)]
        worst = float(np.linalg.norm(residuals[:, :k], axis=0).max())
        if basis.shape[1] == d or worst <= tolerance * max(values[0], 0.0):
            break
        new = residuals[:, :block]
    k = int((values[:k] > RANK * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    vectors = np.linalg.qr(ritz[:, :k])[0] if k else np.zeros((d, 0))
    return Whitening(n, sums, values[:k], vectors, float(total[-1]), worst, passes)


def fit(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", tolerance: float = TOLERANCE) -> Whitening | None:
    """The leading components of all usable rows; None if there are none."""
    return _fit(_packed(usable(vectors, key, vector)), components, tolerance)


def whitened(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", tolerance: float = TOLERANCE) -> DataFrame:
    """For each usable row and component (from 1): key, component, n, deviation, whitened, explained and identity_error."""
    packed = _packed(usable(vectors, key, vector))
    kind = packed.schema["keys"].dataType.elementType.simpleString()
    model, spark = _fit(packed, components, tolerance), vectors.sparkSession
    if model is None or not len(model.values):
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    centre, k = _Centre(model.n, model.sums), len(model.values)
    shared = spark.sparkContext.broadcast((centre, model.vectors / np.sqrt(model.values)))  # d x k numbers

    def moments(x: np.ndarray) -> np.ndarray:
        centre, projection = shared.value
        w = centre(x) @ projection
        return np.append((w.T @ w).ravel(), w.sum(0))

    sums = _added(packed, k * k + k, moments) / model.n
    covariance = sums[: k * k].reshape(k, k) - np.outer(sums[k * k :], sums[k * k :])
    error = float(np.abs(covariance - np.eye(k)).max())

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, projection = shared.value
        for batch in batches:
            for keys, x in zip(batch.column(batch.schema.get_field_index("keys")), _matrices(batch), strict=True):
                c = centre(x)
                w = c @ projection
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(centre.deviations(x, c), pa.int64()), rows], names=["key", "deviation", "w"])

    rows = packed.select("keys", "x", "kind", "width").mapInArrow(project, f"key {kind}, deviation long, w array<double>")
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    each = rows.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
