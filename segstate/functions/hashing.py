"""Deterministic hash-based uniforms, identical in Spark and DuckDB.

``u = int(first 8 hex digits of md5(text), 16) / 2^32`` lies in [0, 1). It
replaces the unseeded random draws of sampling, fold shuffling and the random
model start so that every run (and every recomputed task) sees the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def hash_key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def md5_uniform(key: Column) -> Column:
    """Uniform in [0, 1) from the md5 of ``key``."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def duck_md5_uniform(key_sql: str) -> str:
    """The same uniform as DuckDB SQL text."""
    return f"(('0x' || substr(md5({key_sql}), 1, 8))::BIGINT / {TWO_POW_32})"
