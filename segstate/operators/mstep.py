"""M-step (R11): summed estimates -> new model rows.

The long-form sums of one model (a few hundred cells at most) are gathered
into one row per (fold, cls), put back into row-major arrays and normalised:
Pi by F5, A and B by F6 (per row), P by F7 (whole matrix).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstate.functions.arrays import l1_normalize, matrix_normalize, reshape_row_major, row_stochastic
from segstate.spec import HsmmSpec


def _values(cells: Column, param: str) -> Column:
    """Values of one parameter in (i, j) order (``cells`` is sorted)."""
    return F.transform(F.filter(cells, lambda c: c["param"] == F.lit(param)), lambda c: c["value"])


def gather_sums(stats: DataFrame, spec: HsmmSpec) -> DataFrame:
    """(fold, cls, param, i, j, value) -> one row per model with raw sums."""
    cells = F.array_sort(F.collect_list(F.struct("param", "i", "j", "value")))
    g = stats.groupBy("fold", "cls").agg(cells.alias("_c"))
    c = F.col("_c")
    return g.select(
        "fold", "cls",
        _values(c, "loglik")[0].alias("loglik"),
        _values(c, "n_seq")[0].cast("bigint").alias("n_seq"),
        _values(c, "n_undefined")[0].cast("bigint").alias("n_undefined"),
        _values(c, "pi").alias("pi_sum"),
        reshape_row_major(_values(c, "a"), spec.m, spec.m).alias("a_sum"),
        reshape_row_major(_values(c, "b"), spec.m, spec.k).alias("b_sum"),
        reshape_row_major(_values(c, "p"), spec.m, spec.d).alias("p_sum"),
    )


def _plus(x: Column, eps: float) -> Column:
    return F.transform(x, lambda v: v + F.lit(eps))


def _plus2(x: Column, eps: float) -> Column:
    return F.transform(x, lambda row: _plus(row, eps))


def m_step(stats: DataFrame, spec: HsmmSpec, smoothing: float = 0.0) -> DataFrame:
    """New (pi, a, b, p) and the E-step log-likelihood sum per model.

    ``smoothing`` adds a constant to every summed cell before normalising
    (the reference's disabled variant uses 2^-52); the default 0 is the
    reference behaviour."""
    sums = gather_sums(stats, spec)
    pi, a, b, p = (F.col(c) for c in ("pi_sum", "a_sum", "b_sum", "p_sum"))
    if smoothing:
        pi, a, b, p = _plus(pi, smoothing), _plus2(a, smoothing), _plus2(b, smoothing), _plus2(p, smoothing)
    return sums.select(
        "fold", "cls", "loglik", "n_seq", "n_undefined",
        l1_normalize(pi).alias("pi"),
        row_stochastic(a).alias("a"),
        row_stochastic(b).alias("b"),
        matrix_normalize(p).alias("p"),
    )
