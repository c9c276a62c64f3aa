"""Column expressions shared by the operators.

Spark has no complex type, so a complex number is a pair of columns
``(re, im)``; the helpers below take and return such pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def cmul(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Complex product."""
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def csquare(a: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * a[0] - a[1] * a[1], F.lit(2.0) * a[0] * a[1]


def cpow(a: tuple[Column, Column], order: int) -> tuple[Column, Column]:
    """Integer power by repeated squaring (the expression stays in codegen)."""
    result: tuple[Column, Column] | None = None
    base = a
    while order:
        if order & 1:
            result = base if result is None else cmul(result, base)
        order >>= 1
        if order:
            base = csquare(base)
    return result if result is not None else (F.lit(1.0), F.lit(0.0))


def rotate(a: tuple[Column, Column], angle: Column) -> tuple[Column, Column]:
    """Multiply by ``exp(j * angle)``."""
    return cmul(a, (F.cos(angle), F.sin(angle)))


def power(i: Column, q: Column) -> Column:
    return i * i + q * q


def magnitude(i: Column, q: Column) -> Column:
    return F.sqrt(power(i, q))


def phase(i: Column, q: Column) -> Column:
    return F.atan2(q, i)


def wrap_phase(step: Column) -> Column:
    """Fold a phase step in (-2 pi, 2 pi) into [-pi, pi]; values inside stay as they are."""
    return (
        F.when(step > math.pi, step - TWO_PI)
        .when(step < -math.pi, step + TWO_PI)
        .otherwise(step)
    )


def decibel(value: Column) -> Column:
    return F.lit(10.0) * F.log10(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An expression named inside a lambda is otherwise evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def finite(value: Column) -> Column:
    """NULL for NaN and the infinities, the value otherwise."""
    return F.when(
        F.isnan(value) | (value == float("inf")) | (value == float("-inf")), F.lit(None)
    ).otherwise(value)


def first_max(value: Column, index: Column) -> Column:
    """Ordering key for ``max_by``: highest value, lowest index on ties."""
    return F.struct(value, -index)


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Round every DOUBLE column; adding 0.0 removes the sign of a rounded zero."""
    cols = []
    for name, kind in df.dtypes:
        if kind == "double":
            cols.append((F.round(F.col(name), per_column.get(name, digits)) + F.lit(0.0)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)
