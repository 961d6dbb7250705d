"""Whitening against eigenvectors of the covariance, and its edge cases."""

import math

import numpy as np
import pytest

from scenelake.llm import whitening as w
from scenelake.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, k string, x array<int>, n int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "k", [1], 5, "c") for i, v in rows], SCHEMA).repartition(3)


def brute(vectors):
    """(x rows, n, sums, eigenvalues, eigenvectors by rows) of the different vectors."""
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    rows = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(rows.T @ rows / n)
    return x, n, sums, values[::-1], axes[:, ::-1].T


def test_against_eigenvectors(spark):
    docs = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = w.op12_whitening(spark, "/root/testdata/sf0.01").collect()
    source = [r for r in docs.collect() if r["embedding"] is not None]
    x, n, sums, values, axes = brute([list(map(float, r["embedding"])) for r in source])
    assert len(got) == 16 * len(source)
    at = {(r["vec_id"], r["component"]): r for r in got}
    signs = None
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    expected = centred @ axes[:16].T / np.sqrt(values[:16])
    for row, v, e in zip(source, x, expected):
        mine = [at[row["vec_id"], c] for c in range(1, 17)]
        assert {r["n"] for r in mine} == {n}
        assert {r["deviation"] for r in mine} == {sum((n * c - s) ** 2 for c, s in zip(v, sums))}
        values_of = np.array([r["whitened"] for r in mine])
        signs = np.sign(values_of * e) if signs is None else signs
        assert np.allclose(values_of * signs, e, atol=1e-8)
        assert np.allclose([r["explained"] for r in mine], values[:16] / values.sum(), rtol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9
    assert len({r["identity_error"] for r in got}) == 1


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 3))
    rows = [(i, [a, b, c, a, 2.5, a + 1e-1 * b]) for i, (a, b, c) in enumerate(base.tolist())]
    got = w.whiten(frame(spark, rows)).collect()
    values = brute([v for _, v in rows])[3]
    assert len(got) == 6 * 200
    share = {r["component"]: r["explained"] for r in got}
    for c in range(1, 7):
        assert share[c] == pytest.approx(values[c - 1] / values.sum(), rel=1e-6, abs=1e-15)
    # A dimension that repeats another and one that never changes have no variance left.
    assert {r["component"] for r in got if r["whitened"] is None} == {5, 6} and share[5] == share[6] == 0
    assert got[0]["identity_error"] < 1e-8


def test_narrow_variances(spark):
    """Variances far apart come out to a good relative error; they would be lost in a covariance of such numbers."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 3)) * [4e8, 2e3, 1.0]
    rows = [(i, [a, a + b, b + c]) for i, (a, b, c) in enumerate(base.tolist())]
    got = w.whiten(frame(spark, rows)).collect()
    x, n, sums, _, _ = brute([v for _, v in rows])
    scaled = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in sorted(set(x))])
    values = np.linalg.svd(scaled, compute_uv=False) ** 2 / n
    share = {r["component"]: r["explained"] for r in got}
    assert [share[c] for c in (1, 2, 3)] == pytest.approx((values / values.sum()).tolist(), rel=1e-4)
    assert got[0]["identity_error"] < 1e-4


def test_which_rows_take_part(spark):
    inf = float("inf")
    rows = [
        (1, [0.5, -0.25]), (2, [0.5, -0.25]), (2, [1.0, 3.0]), (None, [2.0, 1.0]), (4, None), (5, []), (6, [1.0, None]),
        (7, [inf, 1.0]), (8, [float("nan"), 1.0]), (9, [1e300, 1.0]), (10, [1.0, 2.0, 3.0]), (11, [0.0, -0.0]), (12, [0.001, 0.001]),
    ]
    got = w.whiten(frame(spark, rows)).collect()
    assert sorted(r["vec_id"] or 0 for r in got if r["component"] == 1) == [0, 1, 2, 2, 11, 12]
    assert {r["n"] for r in got} == {4} and {r["component"] for r in got} == {1, 2}
    copies = [r["whitened"] for r in got if r["component"] == 1 and r["vec_id"] in (11, 12)]
    assert copies[0] == copies[1]


def test_one_vector_and_none(spark):
    one = w.whiten(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(one) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one} == {(1, 0, None, None)}
    assert w.whiten(frame(spark, [(1, [0.5])]).where("false")).collect() == []
    assert w.whiten(frame(spark, [(1, None)])).collect() == []


def test_deviations_past_64_bits(spark):
    big = float(1 << 40)
    got = w.whiten(frame(spark, [(1, [big]), (2, [-big]), (3, [0.0])])).collect()
    x = [(1 << 46) + 1_000_000, 1_000_000 - (1 << 46), 1_000_000]
    exact = {i + 1: (3 * v - sum(x)) ** 2 for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 1 << 63 else None for i, v in exact.items()}
    assert w.deviations(np.array([[1 << 50, 3]]), 2, (1 << 50, 6)) == [None]
    assert w.deviations(np.array([[1 << 30, 3]]), 2, (1 << 30, 6)) == [1 << 60]


def test_parts_of_sums_are_exact():
    x = np.array([[2**62, -(2**62)], [2**62, -(2**62) + 1]])
    assert w._exact_sums(x) == [2**63, -(2**63) + 1]
