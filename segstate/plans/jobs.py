"""The two end-to-end jobs, starting from the reference's input layout (one
headerless ``workitem,str_obs`` CSV per class).

``cross_validation`` : read both classes (S1), sample (P1), number and fold
  (P3, K1, S3), train all 2k models (R12), score the held-out sequences under
  both models (V1, V3) and store per-fold metrics (V4, V5, S8).
``prefix_evaluation`` : re-score the held-out sequences of the same work
  folder on their first T symbols (V2, V7), reusing stored scores (S5).

Both resume from their work folder: folds, models, EM trace, scores and
metrics that exist are read back instead of recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstate.functions.obs import obs_in_range
from segstate.plans import audit
from segstate.plans.crossval import cross_validate, cross_validate_prefix
from segstate.session import new_work_dir
from segstate.sources.store import is_complete, read_raw_lines
from segstate.spec import RunParams


def usable(seqs: DataFrame, params: RunParams, work_dir: str) -> DataFrame:
    """Sequences that can be scored. The others are written to ``rejected`` in
    the work folder with a reason, and the audit table counts both: a line that
    has not two columns (with its text), a null id, no observation, or a symbol
    outside [0, K)."""
    broken = F.col("raw").isNotNull() if "raw" in seqs.columns else F.lit(False)
    reason = (F.when(broken, "malformed line")
              .when(F.col("workitem").isNull(), "no id")
              .when(F.col("obs").isNull() | (F.size("obs") == 0), "no observation")
              .when(~F.coalesce(obs_in_range(F.col("obs"), params.spec.k), F.lit(False)), "symbol out of range"))
    checked = seqs.withColumn("reason", reason)
    if not is_complete(seqs.sparkSession, f"{work_dir}/rejected"):
        audit.count_input(checked, work_dir)
        checked.where("reason is not null").write.mode("overwrite").parquet(f"{work_dir}/rejected")
    return checked.where("reason is null").select("workitem", "cls", "obs")


def cross_validation(spark: SparkSession, class1_csv: str, class0_csv: str,
                     params: RunParams = RunParams(), work_dir: str | None = None) -> DataFrame:
    """Metrics per fold: fold, n, tp, fp, fn, tn, n_undefined, sensitivity,
    specificity, accuracy, error."""
    seqs = read_raw_lines(spark, {1: class1_csv, 0: class0_csv})
    work_dir = work_dir or new_work_dir(spark, "cv")
    return cross_validate(usable(seqs, params, work_dir), params, work_dir, seqs)


def prefix_evaluation(spark: SparkSession, class1_csv: str, class0_csv: str, work_dir: str,
                      prefixes: list[int] | None = None,
                      params: RunParams = RunParams()) -> DataFrame:
    """Metrics per (t_prefix, fold) with the folds and models stored in
    ``work_dir`` by ``cross_validation``."""
    seqs = read_raw_lines(spark, {1: class1_csv, 0: class0_csv})
    return cross_validate_prefix(usable(seqs, params, work_dir), params, work_dir, prefixes or [params.t_prefix], seqs)
