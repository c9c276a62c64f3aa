"""Whitening against exact fractions, numpy's eigenvectors and known polynomials."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from tonelake.llm import queries, whitening
from tonelake.operators.models import FEATURES


def matrix_of(rng, size, rank=None, scale=10**6):
    a = rng.integers(-scale, scale, (size, rank or size)).astype(object)
    return (a @ a.T).tolist()


def exact_polynomial(matrix):
    """Faddeev-LeVerrier with fractions."""
    n = len(matrix)
    a = np.array(matrix, object)
    m, found = np.zeros((n, n), object), [1]
    for k in range(1, n + 1):
        m = a.dot(m) + found[-1] * np.eye(n, dtype=int).astype(object)
        found.append(-Fraction(int(np.trace(a.dot(m))), k))
    assert all(Fraction(c).denominator == 1 for c in found)
    return [int(c) for c in reversed(found)]


@pytest.mark.parametrize(("size", "rank"), [(1, 1), (2, 2), (5, 5), (9, 4), (12, 12)])
def test_characteristic_polynomial_is_exact(spark, size, rank):
    matrix = matrix_of(np.random.default_rng(size), size, rank)
    assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_hessenberg_reduction_with_zero_pivots(spark):
    matrix = [[4, 0, 0, 2], [0, 3, 1, 0], [0, 1, 3, 0], [2, 0, 0, 4]]
    assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)
    assert whitening.characteristic_polynomial(spark, [[5, 0], [0, 5]]) == [25, -10, 1]


def test_roots_with_multiplicity():
    # (x - 7)^2 (x - 3) x
    polynomial = np.polynomial.polynomial.polyfromroots([7, 7, 3, 0]).round().astype(int).tolist()
    assert [whitening.roots_above(polynomial, k, 0) for k in (-1, 0, 3, 6, 7)] == [4, 3, 2, 2, 0]
    found = whitening.largest_roots(polynomial, 4)
    assert [(round(n / 2**b, 9), m) for n, b, m in found] == [(7, 2), (3, 1)]


def test_primes():
    assert whitening.primes_below(100, 3) == [97, 89, 83]
    assert whitening.primes_below(2**31, 1) == [2**31 - 1]


def rows_of(x):
    return [(k, *map(float, row)) for k, row in enumerate(x)]


def whiten(spark, rows, names, **more):
    schema = "capture_id long, " + ", ".join(f"{n} double" for n in names)
    return whitening.whiten_features(spark.createDataFrame(rows, schema), names, **more)


def brute(x, scale, components):
    y = np.floor(x * scale)
    off = y - y.mean(axis=0)
    values, vectors = np.linalg.eigh(off.T @ off / len(y))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return off @ vectors / np.sqrt(values), values / np.trace(off.T @ off / len(y)), y


def test_features_of_captures(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 13)) @ rng.normal(size=(13, 13))
    got = whiten(spark, rows_of(x), FEATURES, components=5).collect()
    want, explained, y = brute(x, 1024, 5)
    assert len(got) == 1500
    table = np.zeros((300, 5))
    for r in got:
        table[r["capture_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == 300 and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-8
    sums = [int(v) for v in y.sum(axis=0)]
    for r in got:
        assert int(r["deviation"]) == sum((300 * int(v) - s) ** 2 for v, s in zip(y[r["capture_id"]], sums, strict=True))


def test_equal_variances_and_less_than_full_rank(spark):
    # Four points of a square, in a plane of a space of three dimensions: two equal variances, one none.
    rows = [(0, 1.0, 0.0, 9.0), (1, -1.0, 0.0, 9.0), (2, 0.0, 1.0, 9.0), (3, 0.0, -1.0, 9.0)]
    got = whiten(spark, rows, ["n", "component", "deviation"], scale=8).collect()
    table = np.zeros((4, 2))
    for r in got:
        table[r["capture_id"], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - 0.5) < 1e-12 and r["identity_error"] < 1e-12
    assert len(got) == 8 and np.abs(table.T @ table / 4 - np.eye(2)).max() < 1e-12


def test_rows_that_take_no_part_and_very_large_features(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) * [1e12, 1, 1]
    rows = rows_of(x) + [(None, *map(float, x[0])), (0, *map(float, x[0]))]
    bad = [(90, None, 1.0, 1.0), (91, float("nan"), 1.0, 1.0), (92, 1.0, float("inf"), 1.0), (93, 1.0, -1e300, 1.0)]
    got = whiten(spark, rows + bad, ["a", "b", "c"], scale=1000).collect()
    assert len(got) == 42 * 3 and {r["n"] for r in got} == {42}
    assert sum(r["capture_id"] is None for r in got) == 3
    y = np.array([[int(np.floor(v * 1000)) for v in row[1:]] for row in rows], object)
    deviation = {k[0]: sum((42 * v - s) ** 2 for v, s in zip(row, y.sum(axis=0), strict=True)) for k, row in zip(rows, y, strict=True)}
    assert all(int(r["deviation"]) == deviation[r["capture_id"]] for r in got)
    assert {r["identity_error"] < 1e-6 for r in got} == {True}


def test_empty_and_constant_tables(spark):
    assert whiten(spark, [], ["a", "b"]).count() == 0
    assert whiten(spark, [(1, 2.0, 3.0)] * 5, ["a", "b"]).count() == 0


def test_query_on_the_small_tables(spark, sf_dir):
    got = queries.op11_whitening(spark, sf_dir).toPandas()
    rows = queries.table(spark, sf_dir, "embeddings").toPandas().sort_values("vec_id")
    x = np.array(rows["embedding"].tolist(), np.float64)
    want, explained, _ = brute(x, 1024, 8)
    assert len(got) == 8 * len(x) and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-7
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() / explained - 1).max() < 1e-9
    y = np.floor(x * 1024).astype(np.int64) + 100_000
    deviation = ((len(y) * y - y.sum(axis=0)) ** 2).sum(axis=1)
    assert (got[got["component"] == 1].sort_values("vec_id")["deviation"].to_numpy() == deviation).all()
