"""Row accounting of a run (V3, Q18): where every input row went.

The audit table (stage, cls, fold, name, n) has the lines read and rejected per
reason, rows kept and ids that repeat inside their class, sequences after the
sample, and per fold the sequences held out and the sequences scored, which are
the two counts that differ when rows are lost between them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "cls int, fold int, name string, n long, stage string"


def _rows(counted: DataFrame, name) -> DataFrame:
    fold = F.col("fold").cast("int") if "fold" in counted.columns else F.lit(None).cast("int")
    return counted.select(F.col("cls").cast("int").alias("cls"), fold.alias("fold"),
                          (F.lit(name) if isinstance(name, str) else name).alias("name"), F.col("n").cast("long").alias("n"))


def _write(rows: DataFrame, work_dir: str, stage: str) -> None:
    """Each stage replaces its own rows, so a repeated run counts once."""
    rows.coalesce(1).write.mode("overwrite").parquet(os.path.join(work_dir, "audit", f"stage={stage}"))


def count_input(checked: DataFrame, work_dir: str) -> None:
    """``checked`` has cls, workitem and a reason, null for rows that are kept."""
    by_reason = checked.groupBy("cls", "reason").agg(F.count("*").alias("n"))
    reasons = _rows(by_reason, F.coalesce(F.concat(F.lit("rejected: "), F.col("reason")), F.lit("kept")))
    every = _rows(by_reason.groupBy("cls").agg(F.sum("n").alias("n")), "read")
    # partial counts per id first, so that an id of many rows stays one row per task
    ids = checked.where("reason is null").groupBy("cls", "workitem").agg(F.count("*").alias("k"))
    repeated = _rows(ids.groupBy("cls").agg(F.sum(F.when(F.col("k") > 1, F.col("k") - 1).otherwise(0)).alias("n")), "repeated ids")
    _write(every.unionByName(reasons).unionByName(repeated), work_dir, "input")


def count_evaluated(folded: DataFrame, scores: DataFrame, work_dir: str) -> None:
    """Sequences held out and scored, per class and fold."""
    held = folded.where("t0 = 0").groupBy("cls", F.col("kfold").alias("fold")).agg(F.count("*").alias("n"))
    scored = scores.groupBy("cls", "fold").agg(F.count("*").alias("n"))
    _write(_rows(held, "held out").unionByName(_rows(scored, "scored")), work_dir, "evaluated")


def read(spark: SparkSession, work_dir: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(os.path.join(work_dir, "audit"))


def lost(audit: DataFrame) -> DataFrame:
    """(cls, fold, held_out, scored) where the two differ."""
    side = audit.where("stage = 'evaluated'").groupBy("cls", "fold").agg(
        F.sum(F.when(F.col("name") == "held out", F.col("n")).otherwise(0)).alias("held_out"),
        F.sum(F.when(F.col("name") == "scored", F.col("n")).otherwise(0)).alias("scored"))
    return side.where("held_out <> scored")
