"""Whitening of feature vectors from the exact characteristic polynomial of their scatter.

Features become integers, so their scatter matrix is one of integers too and nothing about it
is rounded. Its characteristic polynomial is found modulo many primes, a task per group of
primes: reduction to Hessenberg form, then the recurrence of the leading minors. The residues
give the exact coefficients by the Chinese remainder theorem. All roots are real, so Descartes'
rule counts the roots beyond a number exactly; bisection isolates the largest ones to
``ROOT_BITS`` bits, and inverse iteration at such a root finds its null space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.records import extended
from tonelake.operators.models import FEATURES
from tonelake.session import pin

#: Significant bits to which a root is found.
ROOT_BITS = 220
#: Partial sums travel as two decimals: multiples of this number and the rest.
_LIMB = 10**30


@dataclass(frozen=True)
class Whitening:
    """``vectors[c]`` is a unit eigenvector for ``values[c]``, an eigenvalue of the covariance; falling order."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    explained: list[float]


# -- integers ------------------------------------------------------------------


def _usable(features: DataFrame, names: Sequence[str], scale: int) -> DataFrame:
    """``(capture_id, vector array<double>)`` of the rows whose features are all finite integers in range."""
    vector = F.array(*[F.col(f"`{name}`").cast("double") for name in names])
    fits = F.forall("vector", lambda c: F.coalesce(F.abs(c) < float(2**62 // scale), F.lit(False)))
    return features.select("capture_id", vector.alias("vector")).where(fits)


def _integers(vectors: pa.Array, width: int, scale: int, offset: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(flat * scale).astype(np.int64) + offset


def products(x: np.ndarray) -> np.ndarray:
    """Exact ``x.T @ x`` as Python integers. Float sums are exact while they stay below 2^53."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    rows = 2**53 // most**2
    if rows < 16:
        return x.T.astype(object) @ x.astype(object)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for k in range(0, len(x), rows):
        part = x[k : k + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def scatter(usable: DataFrame, width: int, scale: int, offset: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums, and sums of products, all exact.

    A task adds up its rows and sends one number per pair of dimensions; Spark adds these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            x = _integers(batch.column(0), width, scale, offset)
            n += len(x)
            sums = sums + x.astype(object).sum(axis=0) if len(x) else sums
            total = total + products(x)
        if not n:
            return
        cells = [(-1, -1, n), *((-1, j, sums[j]) for j in range(width))]
        cells += [(i, j, total[i, j]) for i in range(width) for j in range(i, width)]
        split = [divmod(int(v), _LIMB) for _, _, v in cells]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c[0] for c in cells], pa.int32()),
                pa.array([c[1] for c in cells], pa.int32()),
                pa.array([Decimal(high) for high, _ in split], pa.decimal128(38, 0)),
                pa.array([Decimal(low) for _, low in split], pa.decimal128(38, 0)),
            ],
            ["i", "j", "high", "low"],
        )

    parts = usable.select("vector").mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    cells = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    value = {(r["i"], r["j"]): int(r["high"]) * _LIMB + int(r["low"]) for r in cells}
    if not value:
        return 0, [0] * width, [[0] * width for _ in range(width)]
    pairs = [[value[min(i, j), max(i, j)] for j in range(width)] for i in range(width)]
    return value[-1, -1], [value[-1, j] for j in range(width)], pairs


# -- the characteristic polynomial -----------------------------------------------


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``limit``."""
    small = np.arange(3, math.isqrt(limit) + 2, 2)
    found, candidate = [], limit - 1 - limit % 2
    while len(found) < count:
        if (candidate % small[small * small <= candidate]).all():
            found.append(candidate)
        candidate -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo the prime ``p`` < 2^31, constant one first."""
    h = matrix.astype(np.int64) % p
    size = len(h)
    for k in range(1, size - 1):
        pivot = np.flatnonzero(h[k:, k - 1])
        if not len(pivot):
            continue
        if pivot[0]:
            i = k + int(pivot[0])
            h[[k, i]] = h[[i, k]]
            h[:, [k, i]] = h[:, [i, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        # The similarity that clears the column: rows lose multiples of row k, column k gains those of the others.
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((size + 1, size + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, size + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        weight, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weight[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else below
        minors[k] = (minors[k] - (weight[:, None] * minors[:k] % p).sum(axis=0)) % p
    return minors[size]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x - matrix) for a positive semidefinite matrix of integers, constant one first.

    Coefficient k is, but for its sign, a symmetric sum of products of roots, at most
    ``(1 + trace/size)^size`` by the means' inequality; as many primes are taken as that needs.
    """
    size = len(matrix)
    trace = sum(matrix[i][i] for i in range(size))
    bound = 2 * ((size + trace) ** size // size**size + 2)
    primes = primes_below(2**31, math.ceil(bound.bit_length() / 30.9) + 1)
    rows = [[str(v) for v in row] for row in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [[int(v) for v in row] for row in rows]
        for batch in batches:
            chosen = [primes[k] for k in batch.column(0).to_pylist()]
            found = [polynomial_mod(np.array([[v % p for v in row] for row in exact]), p).tolist() for p in chosen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["prime", "residues"]
            )

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    residues = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "prime long, residues array<long>").collect()
    whole = math.prod(primes)
    lifts = []
    for row in residues:
        others = whole // row["prime"]
        lifts.append(others * pow(others % row["prime"], -1, row["prime"]))
    found = []
    for k in range(size + 1):
        value = sum(row["residues"][k] * lift for row, lift in zip(residues, lifts, strict=True)) % whole
        found.append(value - whole if value > whole // 2 else value)
    return found


# -- roots -----------------------------------------------------------------------


def roots_above(polynomial: list[int], place: int, bits: int) -> int:
    """How many roots, with multiplicity, of a polynomial with real roots only exceed ``place / 2^bits``."""
    degree = len(polynomial) - 1
    shifted = [c << bits * (degree - k) for k, c in enumerate(polynomial)]
    for k in range(degree):
        for i in range(degree - 1, k - 1, -1):
            shifted[i] += place * shifted[i + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(polynomial: list[int], place: int, bits: int) -> int:
    value = 0
    for k, c in enumerate(reversed(polynomial)):
        value = value * place + (c << bits * k)
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int) -> list[tuple[int, int, int]]:
    """``(numerator, bits, multiplicity)`` of the largest positive roots, in falling order.

    A root is ``numerator / 2^bits`` but for less than ``2^-bits``. Roots that differ by less are
    one with their joint multiplicity. Multiplicities add up to ``count`` or to all positive ones.
    """
    positive = roots_above(polynomial, 0, 0)
    found: list[tuple[int, int, int]] = []
    # No root exceeds the sum of all; they are not negative.
    high, bits, done = 1 << abs(polynomial[-2]).bit_length(), 0, 0
    while done < min(count, positive):
        # ``over`` roots lie above ``low``, more than ``done``; ``above`` lie above ``high``, at most ``done``.
        low, over, above = 0, positive, done
        while True:
            if high - low == 1:
                if high.bit_length() > ROOT_BITS:
                    break
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            if over - above == 1:
                # A single root: the sign at a place tells the side, as it is (-1)^(roots above).
                further = over if _sign(polynomial, middle, bits) * (-1) ** above < 0 else above
            else:
                further = roots_above(polynomial, middle, bits)
            if further > done:
                low, over = middle, further
            else:
                high, above = middle, further
        found.append((high, bits, over - above))
        done, high = over, low
    return found


def _null_space(matrix: list[list[int]], numerator: int, bits: int, count: int) -> list[list[Decimal]]:
    """Orthonormal vectors that the matrix maps to about ``numerator / 2^bits`` of themselves.

    Inverse iteration with one triangular factorisation; each step takes all but about
    ``2^-ROOT_BITS`` of other directions away. Runs in the caller's decimal context.
    """
    size = len(matrix)
    root = Decimal(numerator) / Decimal(1 << bits)
    lower = np.array([[Decimal(v) for v in row] for row in matrix], object)
    for i in range(size):
        lower[i, i] -= root
    order = list(range(size))
    tiny = abs(root).scaleb(-100)
    for k in range(size):
        best = max(range(k, size), key=lambda i: abs(lower[i, k]))
        if best != k:
            lower[[k, best]] = lower[[best, k]]
            order[k], order[best] = order[best], order[k]
        if abs(lower[k, k]) < tiny:
            lower[k, k] = tiny
        if k + 1 < size:
            lower[k + 1 :, k] = lower[k + 1 :, k] / lower[k, k]
            lower[k + 1 :, k + 1 :] = lower[k + 1 :, k + 1 :] - np.outer(lower[k + 1 :, k], lower[k, k + 1 :])

    def solve(right: np.ndarray) -> np.ndarray:
        out = right[order]
        for k in range(1, size):
            out[k] -= lower[k, :k].dot(out[:k])
        for k in range(size - 1, -1, -1):
            if k + 1 < size:
                out[k] -= lower[k, k + 1 :].dot(out[k + 1 :])
            out[k] /= lower[k, k]
        return out

    found: list[np.ndarray] = []
    for c in range(count):
        vector = np.array([Decimal((k * k * 7 + (c + 3) * k * 11 + c * c) % 101 + 1) for k in range(size)], object)
        for _ in range(3):
            for other in found:
                vector = vector - other * other.dot(vector)
            vector = vector / vector.dot(vector).sqrt()
            vector = solve(vector)
        for other in found:
            vector = vector - other * other.dot(vector)
        found.append(vector / vector.dot(vector).sqrt())
    return [list(v) for v in found]


# -- whitening -------------------------------------------------------------------


def fit_whitening(spark: SparkSession, n: int, sums: list[int], pairs: list[list[int]], components: int) -> Whitening:
    """Leading components of the covariance, divisor ``n``, from exact sums.

    ``n`` times the sums of products less the products of sums is ``n^2`` times the covariance,
    without rounding. Signs: the entry of a vector that is largest in size (the first such) is positive.
    """
    size = len(sums)
    matrix = [[n * pairs[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    common = math.gcd(*(v for row in matrix for v in row)) if size else 0
    if not common:
        return Whitening(n, sums, [], np.zeros((0, size)), [])
    matrix = [[v // common for v in row] for row in matrix]
    trace = sum(matrix[i][i] for i in range(size))
    roots = largest_roots(characteristic_polynomial(spark, matrix), components)
    values, vectors, explained = [], [], []
    with localcontext() as context:
        context.prec = 120 + len(str(trace))
        for numerator, bits, count in roots:
            root = Decimal(numerator) / Decimal(1 << bits)
            for vector in _null_space(matrix, numerator, bits, count):
                lead = max(range(size), key=lambda k: (abs(vector[k]), -k))
                sign = -1 if vector[lead] < 0 else 1
                vectors.append([float(sign * v) for v in vector])
                values.append(float(root * common / (Decimal(n) * n)))
                explained.append(float(root / trace))
    vectors, values, explained = vectors[:components], values[:components], explained[:components]
    return Whitening(n, sums, values, np.array(vectors).reshape(-1, size), explained)


def _project(usable: DataFrame, fit: Whitening, scale: int, offset: int) -> DataFrame:
    n, sums = fit.n, fit.sums
    weights, width = fit.vectors.T / np.sqrt(fit.values), len(fit.sums)
    schema = extended(usable, ["capture_id"], "deviation decimal(38,0), whitened array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most_sum = max(abs(s) for s in sums)
        for batch in batches:
            x = _integers(batch.column(1), width, scale, offset)
            if not len(x):
                continue
            most = n * max(int(np.abs(x).max()), 1) + most_sum
            if most < 2**62:
                off = n * x - np.array(sums, np.int64)
                whole = off if width * int(np.abs(off).max()) ** 2 < 2**63 else off.astype(object)
            else:
                off = whole = n * x.astype(object) - np.array(sums, object)
            deviation = (whole * whole).sum(axis=1)
            whitened = (off.astype(np.float64) / n) @ weights
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)),
                    pa.array(list(whitened), pa.list_(pa.float64())),
                ],
                schema.names,
            )

    return usable.mapInArrow(run, schema)


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` arrays minus the identity; centred before multiplying."""
    w = [F.col("whitened")[c] for c in range(components)]
    means = whitened.select(*[F.avg(v) for v in w]).first()
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    off = [v - F.lit(m) for v, m in zip(w, means, strict=True)]
    covariance = whitened.select(*[F.avg(off[i] * off[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(covariance, pairs, strict=True))


def whiten_features(
    features: DataFrame,
    names: Sequence[str] = FEATURES,
    scale: int = 1024,
    offset: int = 0,
    components: int = 8,
) -> DataFrame:
    """Project every feature vector on the leading components of all of them, with unit variance each.

    ``features(capture_id, <names>)`` -> a row per vector and component: ``capture_id, component
    int`` (from 1, by falling variance), ``n long`` (vectors fitted), ``deviation decimal(38,0)``
    (exact sum over features of ``(n x - sum of x)^2``), ``whitened double, explained double``
    (share of the component in the variance), ``identity_error double`` (one value, see there).
    A feature c counts as the integer ``x = floor(scale * c) + offset``.

    All vectors are fitted and returned. Rows with a null, NaN or infinite feature, or one beyond
    ``2^62 / scale``, take no part; repeated rows count each, a null ``capture_id`` stays null.
    Components of no variance do not exist, so there may be fewer than ``components`` (none for
    equal vectors or an empty table: an empty result). For equal variances any orthonormal choice
    is one; it is the same for all rows. Other columns, whatever their names, are not read.

    The driver sees numbers per pair of features, not per row. The residues of the polynomial are
    dealt out by prime, so wide vectors use the cluster for them too.
    """
    usable = _usable(features, list(names), scale)
    n, sums, pairs = scatter(usable, len(names), scale, offset)
    fit = fit_whitening(features.sparkSession, n, sums, pairs, components)
    if not fit.values:
        empty = extended(usable, ["capture_id"], "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
        return features.sparkSession.createDataFrame([], empty)
    whitened = pin(_project(usable, fit, scale, offset))
    error = identity_error(whitened, len(fit.values))
    each = whitened.select("capture_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "capture_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.lit(fit.explained)[F.col("place")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
