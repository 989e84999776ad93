"""Observation-sequence Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_obs(str_obs: Column) -> Column:
    """``'0;3;1'`` -> ``array<int>``; what is no number is a null symbol, which
    no model accepts (Q17)."""
    return F.transform(F.split(str_obs, ";"), lambda x: x.try_cast("int"))


def obs_to_str(obs: Column) -> Column:
    """Inverse of F1: ``array<int>`` -> ``'0;3;1'``."""
    return F.concat_ws(";", F.transform(obs, lambda x: x.cast("string")))


def obs_length(obs: Column) -> Column:
    """sequence length T."""
    return F.size(obs)


def obs_prefix(obs: Column, t: int | Column) -> Column:
    """the first ``min(T, t)`` symbols."""
    t_col = t if isinstance(t, Column) else F.lit(int(t))
    return F.slice(obs, 1, F.least(F.size(obs), t_col))


def emission_lookup(obs: Column, b: Column) -> Column:
    """``[t][j] = B[j][obs[t]]`` for a row-major ``b`` (states x symbols)."""
    return F.transform(obs, lambda o: F.transform(b, lambda row: row[o]))


def symbol_index(value: Column, alphabet: Sequence[str]) -> Column:
    """0-based position of ``value`` in ``alphabet``; -1 when absent."""
    return (F.array_position(F.array(*[F.lit(a) for a in alphabet]), value) - 1).cast("int")


def obs_in_range(obs: Column, k: int) -> Column:
    """True when every symbol lies in ``[0, k)`` (Q17: checked up front)."""
    return F.forall(obs, lambda o: (o >= 0) & (o < k))
