"""Forward recursion and sequence scores as Spark expressions.

The recursion is a left fold (``aggregate``) over the observation array whose
state holds only what the next step reads: the last D-1 forward-prime vectors,
the last D-1 emission vectors and the running score. Memory per row is
O(M*D) whatever the sequence length, and the whole fold runs in the JVM.

- segment likelihood u(t,j,d) = b(j,t) * prod_{x=0..d-1} b(j,t-x) (Q2, the
  latest emission enters twice); duration column 0 reads a forward-prime
  value that is still zero (Q1);
- alpha(.,t) is divided by its plain sum s_t (kept when s_t = 0) and the
  score is sum_t ln(s_t); the L1 rescaling of alpha' is not added back (Q6);
- alpha'(j,t+1) = sum_{i != j} alpha(i,t) A(i,j), then L1-normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstate.functions.arrays import ieee_ln, l1_normalize, let
from segstate.functions.obs import obs_prefix
from segstate.spec import HsmmSpec

_STATE = "struct<ap:array<double>,eh:array<double>,score:double>"


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _l1_fixed(v: Column, m: int) -> Column:
    """F5 on a bound vector of known length m, unrolled (no nested lambdas)."""
    def norm(n: Column) -> Column:
        return F.when(n == 0, v).otherwise(F.array(*[v[i] / n for i in range(m)]))
    return let(_sum([F.abs(v[i]) for i in range(m)]), norm)


def forward_score(obs: Column, pi: Column, a: Column, b: Column, p: Column,
                  spec: HsmmSpec) -> Column:
    """R2 + R3: the sequence score of ``obs`` under (pi, a, b, p), row-major.

    The loops over states and durations are unrolled (M and D are fixed per
    plan), so one fold step is a fixed expression of scalar arithmetic. The
    state keeps the histories flat, newest first: ``ap[(d-1)*M + j]`` is
    alpha'(j, t-d+1) and ``eh[x*M + j]`` is b(j, o_{t-x})."""
    m, keep = spec.m, spec.d - 1
    width = keep * m
    init = F.struct(
        F.slice(l1_normalize(pi), 1, width).alias("ap"),
        F.array().cast("array<double>").alias("eh"),
        F.lit(0.0).alias("score"),
    ).cast(_STATE)

    def merge(acc: Column, o: Column) -> Column:
        e = [F.get(b[j], o) for j in range(m)]
        hist = F.slice(F.concat(F.array(*e), acc["eh"]), 1, width)

        def with_hist(eh: Column) -> Column:
            avail = F.size(eh)

            def alpha(j: int) -> Column:
                # d = 0 reads alpha'(j, t+1), still zero (Q1)
                terms = [F.lit(0.0) * p[j][0] * e[j]]
                u = e[j]
                for d in range(1, keep + 1):
                    u = u * eh[(d - 1) * m + j]  # u(t,j,d), latest emission twice (Q2)
                    terms.append(F.when(avail >= d * m, acc["ap"][(d - 1) * m + j] * p[j][d] * u)
                                 .otherwise(F.lit(0.0)))
                return _sum(terms)

            def with_alpha(al: Column) -> Column:
                def with_scale(sc: Column) -> Column:
                    an = [F.when(sc == 0, al[i]).otherwise(al[i] * (F.lit(1.0) / sc)) for i in range(m)]
                    moved = F.array(*[_sum([F.lit(0.0)] + [an[i] * a[i][j] for i in range(m) if i != j])
                                      for j in range(m)])
                    return F.struct(
                        F.slice(F.concat(let(moved, lambda mv: _l1_fixed(mv, m)), acc["ap"]), 1, width).alias("ap"),
                        eh.alias("eh"),
                        (acc["score"] + ieee_ln(sc)).alias("score"),
                    )
                return let(_sum([al[j] for j in range(m)]), with_scale)
            return let(F.array(*[alpha(j) for j in range(m)]), with_alpha)
        return let(hist, with_hist)

    return F.aggregate(obs, init, merge, lambda acc: acc["score"])


def model_columns(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return (F.col(f"{prefix}pi"), F.col(f"{prefix}a"), F.col(f"{prefix}b"), F.col(f"{prefix}p"))


def score_sequences(seqs: DataFrame, models: DataFrame, spec: HsmmSpec, keys: list[str],
                    t_prefix: int | None = None, out: str = "score") -> DataFrame:
    """V1 / V2: score every row of ``seqs`` under the model row with the same
    ``keys`` (model columns pi, a, b, p). ``t_prefix`` keeps the first T symbols.

    The model table has one row per key, its size is bounded by the number
    of models; it is attached with a size-checked broadcast equi-join."""
    from segstate.operators.joins import attach_models

    joined = attach_models(seqs, models.select(*keys, "pi", "a", "b", "p"), keys, spec)
    obs = F.col("obs") if t_prefix is None else obs_prefix(F.col("obs"), t_prefix)
    pi, a, b, p = model_columns()
    return joined.withColumn(out, forward_score(obs, pi, a, b, p, spec)).drop("pi", "a", "b", "p")
