"""Scoring sequences that arrive on a stream.

The reference is batch only; this module applies the same scoring pass (V1 / V3
/ P8) to a streaming sequence source: every micro-batch of sequence rows goes
through the vectorised kernel with the models that travel with its tasks, so no
state is kept between micro-batches (each sequence is complete when it arrives).
Models are read from the model table written by a cross-validation run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.operators.evaluate import predict, score_both
from segstate.spec import HsmmSpec


def score_stream(seqs: DataFrame, models: DataFrame, spec: HsmmSpec, n_folds: int,
                 t_prefix: int | None = None) -> DataFrame:
    """``seqs`` (streaming or batch) has workitem, cls, fold, obs; returns
    workitem, cls, fold, score1, score0, predicted."""
    scored = score_both(seqs, models, spec, n_folds, t_prefix)
    return scored.withColumn("predicted", predict(F.col("score1"), F.col("score0")))


def sequence_stream(spark, path: str, fold: int, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming source of stored sequence rows (workitem, cls, str_obs)
    written as Parquet, scored under the models of ``fold``. A limit of files per
    micro-batch is only set when it is asked for."""
    from segstate.functions.obs import parse_obs

    reader = spark.readStream.schema("workitem string, cls int, str_obs string")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(path)
    return raw.select("workitem", "cls", F.lit(fold).alias("fold"),
                      parse_obs(F.col("str_obs")).alias("obs"))
