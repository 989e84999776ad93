"""Model parameters as Columns: random start (F11) and convergence test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstate.functions.arrays import l1_normalize, matrix_normalize, row_stochastic
from segstate.functions.hashing import hash_key, md5_uniform
from segstate.spec import HsmmSpec

EPS_2_52 = 2.0 ** -52


def _grid(rows: int, cols: int, cell) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(rows - 1)),
        lambda i: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: cell(i, j)),
    )


def init_model_columns(fold: Column, cls: Column, spec: HsmmSpec, seed: int,
                       smoothing: float = 0.0) -> dict[str, Column]:
    """uniform Pi (F5), A and B row-stochastic (F6), P whole-matrix.

    Every cell is ``md5_uniform(seed:fold:cls:param:i:j)`` (+ ``smoothing``).
    """
    def u(param: str):
        return lambda i, j: md5_uniform(hash_key(F.lit(seed), fold, cls, F.lit(param), i, j)) + F.lit(smoothing)

    pi_raw = F.transform(F.sequence(F.lit(0), F.lit(spec.m - 1)), lambda i: u("pi")(i, F.lit(0)))
    return {
        "pi": l1_normalize(pi_raw),
        "a": row_stochastic(_grid(spec.m, spec.m, u("a"))),
        "b": row_stochastic(_grid(spec.m, spec.k, u("b"))),
        "p": matrix_normalize(_grid(spec.m, spec.d, u("p"))),
    }


def init_models(model_keys: DataFrame, spec: HsmmSpec, seed: int, smoothing: float = 0.0) -> DataFrame:
    """One start model per ``(fold, cls)`` row of ``model_keys``."""
    cols = init_model_columns(F.col("fold"), F.col("cls"), spec, seed, smoothing)
    return model_keys.select(
        F.col("fold").cast("int").alias("fold"),
        F.col("cls").cast("int").alias("cls"),
        F.lit(spec.m).alias("m"), F.lit(spec.k).alias("k"), F.lit(spec.d).alias("d"),
        cols["pi"].alias("pi"), cols["a"].alias("a"), cols["b"].alias("b"), cols["p"].alias("p"),
    )


def em_converged(loglik: Column, previous: Column, threshold: float) -> Column:
    """relative change below ``threshold``. A missing previous value is
    -Infinity, which makes the ratio NaN and the test false."""
    prev = F.coalesce(previous, F.lit(float("-inf")))
    delta = F.abs(loglik - prev)
    avg = (F.abs(loglik) + F.abs(prev) + F.lit(EPS_2_52)) / 2
    ratio = F.when(avg != 0, delta / avg).otherwise(F.lit(float("nan")))
    return F.coalesce(ratio < F.lit(threshold), F.lit(False))


def init_model_values(fold: int, cls: int, spec: HsmmSpec, seed: int) -> dict[str, list]:
    """The F11 start model of one (fold, cls) as Python lists: the same md5
    rule as ``init_models``, evaluated on the driver for a single model (a
    handful of numbers, used as plan literals)."""
    import hashlib

    def u(param: str, i: int, j: int) -> float:
        key = f"{seed}:{fold}:{cls}:{param}:{i}:{j}"
        return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 4294967296.0

    def l1(v):
        n = sum(abs(x) for x in v)
        return v if n == 0 else [x / n for x in v]

    def grid(param, rows, cols):
        return [[u(param, i, j) for j in range(cols)] for i in range(rows)]

    p = grid("p", spec.m, spec.d)
    r = 1.0 / sum(sum(row) for row in p)
    return {
        "pi": l1([u("pi", i, 0) for i in range(spec.m)]),
        "a": [l1(row) for row in grid("a", spec.m, spec.m)],
        "b": [l1(row) for row in grid("b", spec.m, spec.k)],
        "p": [[x * r for x in row] for row in p],
    }
