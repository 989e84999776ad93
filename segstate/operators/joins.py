"""Attaching model rows to sequence rows.

The model table has one row per (fold, class) or per fold: its size is
``n_models * row_bytes`` where ``row_bytes`` follows from (M, K, D). When that
bound is under the broadcast limit the table is broadcast (no shuffle of the
sequences). Beyond it the join is salted: every model row is replicated
``salts`` times and each sequence row picks one salt from a hash of its
columns, so the few join keys (2k at most) are spread over many tasks instead
of one task per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.spec import HsmmSpec

DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024


def broadcast_limit(spark) -> int:
    conf = spark.conf.get("segstate.modelBroadcastLimit", None)
    return int(conf) if conf else DEFAULT_BROADCAST_LIMIT


def model_table_bytes(n_models: int, spec: HsmmSpec, per_row_models: int = 1) -> int:
    return n_models * per_row_models * spec.model_row_bytes()


def attach_single_model(big: DataFrame, model: DataFrame) -> DataFrame:
    """Attach the only row of a one-model table as literal columns.

    The row is a handful of doubles (checked: exactly one row, at most two
    fetched), so it becomes constants of the plan instead of a join."""
    rows = model.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected exactly one model row, got {len(rows)}")
    row = rows[0].asDict(recursive=True)
    cols = [F.lit(v).alias(k) for k, v in row.items() if k not in big.columns]
    return big.select("*", *cols)


def attach_models(big: DataFrame, models: DataFrame, keys: list[str], spec: HsmmSpec,
                  n_models: int | None = None, per_row_models: int = 1,
                  salts: int | None = None, how: str = "inner") -> DataFrame:
    """Equi-join ``big`` with the small ``models`` table on ``keys``."""
    spark = big.sparkSession
    if not keys:
        return attach_single_model(big, models)
    if n_models is None:
        n_models = models.count()  # the model table is tiny; this bounds it
    size = model_table_bytes(n_models, spec, per_row_models)
    if size <= broadcast_limit(spark):
        return big.join(F.broadcast(models), on=keys, how=how)
    if salts is None:
        salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted_models = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return salted_big.join(salted_models, on=[*keys, "_salt"], how=how).drop("_salt")
