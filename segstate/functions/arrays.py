"""Numeric Column helpers with IEEE-754 semantics.

Spark SQL returns NULL (or raises under ANSI mode) for a division by zero and
NULL for ``ln`` of a non-positive number, while the model arithmetic is plain
double arithmetic (x/0 = +-Inf, 0/0 = NaN, ln 0 = -Inf, ln(-x) = NaN). These
helpers keep the double semantics inside JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def pos_inf() -> Column:
    return F.lit(float("inf"))


def neg_inf() -> Column:
    return F.lit(float("-inf"))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with double semantics for a zero divisor."""
    return (
        F.when(b != 0, a / b)
        .when(F.isnan(a) | (a == 0), nan())
        .when(a > 0, pos_inf())
        .otherwise(neg_inf())
    )


def ieee_ln(x: Column) -> Column:
    """Natural log with ln(0) = -Inf and ln(negative) = NaN."""
    return (
        F.when(F.isnan(x), nan())
        .when(x > 0, F.log(x))
        .when(x == 0, neg_inf())
        .otherwise(nan())
    )


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def array_abs_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + F.abs(x))


def l1_normalize(arr: Column) -> Column:
    """divide by the sum of absolute values; a zero vector is unchanged."""
    def _norm(n: Column) -> Column:
        return F.when(n == 0, arr).otherwise(F.transform(arr, lambda x: x / n))
    return let(array_abs_sum(arr), _norm)


def row_stochastic(mat: Column) -> Column:
    """F5 on every row of a row-major matrix (array<array<double>>)."""
    return F.transform(mat, l1_normalize)


def matrix_normalize(mat: Column) -> Column:
    """multiply the whole matrix by 1/sum (no zero guard)."""
    total = F.aggregate(mat, F.lit(0.0), lambda s, row: s + array_sum(row))

    def _scale(r: Column) -> Column:
        return F.transform(mat, lambda row: F.transform(row, lambda x: x * r))
    return let(ieee_div(F.lit(1.0), total), _scale)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(value)`` (avoids re-evaluation
    of a sub-expression inside higher-order functions)."""
    return F.transform(F.array(value), body)[0]


def reshape_row_major(flat: Column, rows: int, cols: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(rows - 1)),
        lambda i: F.slice(flat, i * cols + 1, cols),
    )
