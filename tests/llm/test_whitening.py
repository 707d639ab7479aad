"""Whitening against a dense eigensolver on exact whole numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import whitening as W

KIND = "vec_id long, embedding array<double>"


def brute(vectors, k):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(a * n - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    return deviation, values[:k], centred @ axes[:, :k] / np.sqrt(values[:k]), values.sum()


def agrees(out, rows, k, tolerance=1e-9):
    deviation, values, white, trace = brute([v for _, v in rows], k)
    got = {(r.vec_id, r.component): r for r in out.collect()}
    assert len(got) == len(rows) * len(values)
    for c in range(len(values)):
        mine = np.array([got[i, c + 1].whitened for i, _ in rows])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < tolerance
        assert all(abs(got[i, c + 1].explained / (values[c] / trace) - 1) < 1e-9 for i, _ in rows[:3])
    assert [got[i, 1].deviation for i, _ in rows] == deviation and {r.n for r in got.values()} == {len(rows)}
    assert len({r.identity_error for r in got.values()}) == 1 and got[rows[0][0], 1].identity_error < 1e-9


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], KIND)


def test_near_equal_eigenvalues(spark):
    vectors = np.random.default_rng(1).normal(size=(700, 48)) / 7
    rows = [(i, list(v)) for i, v in enumerate(vectors)]
    df = table(spark, rows).repartition(5)
    agrees(W.whitened(df), rows, 32)
    assert W.fit(df).passes <= 2


def test_few_components_of_many_dimensions(spark):
    """More than one pass: the block is far smaller than the space."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 120)) * np.exp(-np.arange(120) / 15) @ np.linalg.qr(rng.normal(size=(120, 120)))[0] + 40
    rows = [(i, list(v)) for i, v in enumerate(vectors)]
    df = table(spark, rows).repartition(3)
    agrees(W.whitened(df, 5), rows, 5)
    model = W.fit(df, 5)
    assert 2 <= model.passes <= 10 and model.residual <= W.TOLERANCE * model.values[0] or model.passes == 10
    assert W.fit(df, 5, tolerance=1e-3).passes < model.passes


def test_rows_that_are_dropped(spark):
    rng = np.random.default_rng(3)
    rows = [(i, list(v)) for i, v in enumerate(rng.normal(size=(40, 3)))]
    bad = [(100, None), (101, []), (102, [1, None, 2]), (103, [float("nan"), 0, 0]), (104, [float("inf"), 0, 0]), (105, [1, 2]), (106, [1, -float("inf"), 2])]
    agrees(W.whitened(table(spark, rows + bad).repartition(4)), rows, 32)


def test_ranks_ties_and_odd_tables(spark):
    assert W.whitened(table(spark, [])).count() == 0 and W.whitened(table(spark, [(1, None)])).count() == 0
    assert W.whitened(table(spark, [(1, [1.0, 2.0])])).count() == 0, "one row has no variance"
    assert W.whitened(table(spark, [(i, [3.0, 4.0]) for i in range(9)])).count() == 0
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(10)]
    agrees(W.whitened(table(spark, line)), line, 3)
    twice = line + line
    out = W.whitened(table(spark, twice + [(None, [3.0, 6.0, 7.0])]))
    assert out.count() == 21 and out.where("vec_id IS NULL").count() == 1
    named = table(spark, line).select(F.col("vec_id").cast("string").alias("vec_id"), "embedding", F.lit(1).alias("component"), F.lit(2).alias("n"), F.lit(2).alias("key"))
    assert W.whitened(named).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert W.whitened(named).schema["vec_id"].dataType.simpleString() == "string"


def test_large_numbers(spark):
    """Wide types, wrapped arithmetic, and deviations that 64 bits can't hold."""
    rows = [(i, [1e9 + i, -3.0 * i, 1e12]) for i in range(50)]
    agrees(W.whitened(table(spark, rows)), rows, 2, 1e-6)
    huge = [(i, [1e30 * (i % 2), 1.0 * i]) for i in range(10)]
    assert {r.deviation for r in W.whitened(table(spark, huge)).collect()} == {2**63 - 1}


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_deviations_are_exact(n):
    rng = np.random.default_rng(n)
    x = rng.integers(-(2**20), 2**20, (n, 5))
    sums = [int(s) for s in x.sum(0)]
    centre = W._Centre(n, sums)
    want = [min(2**63 - 1, sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True))) for row in x]
    assert centre.deviations(x, centre(x)) == want
