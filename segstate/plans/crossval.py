"""k-fold cross-validation (V6) and prefix evaluation (V7) as Spark jobs.

V6: sample (P1) -> fold assignment (K1, written as the folds table S3) ->
EM for all 2k models together (R12) -> one scoring pass where every held-out
sequence is scored under both models of its fold (V1/V3) -> confusion counts
and metrics of all folds in one aggregate (V4/V5) -> metrics table (S8).

V7 reuses the folds table and the trained models and scores prefixes of the
held-out sequences, all lengths in one pass. Scores already saved for a
(t_prefix, fold) are read back instead (S5), and metrics already stored for it are
not computed again.

A work folder belongs to one run: its manifest (``sources.manifest``) is compared
before anything is reused.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.operators.evaluate import confusion_counts, fold_metrics, score_both
from segstate.operators.folds import folded_sequences, validation_rows
from segstate.plans import audit
from segstate.plans.em import train_models
from segstate.session import materialize
from segstate.sources import manifest
from segstate.sources.blocks import array_blocks
from segstate.sources.events import hash_sample
from segstate.sources.store import (append_metrics, has_partitions, is_complete, pending_folds, read_folds, read_scores,
                                    write_folds, write_scores)
from segstate.spec import RunParams


def prepare_folds(seqs: DataFrame, params: RunParams, work_dir: str) -> DataFrame:
    """Sample, number, assign folds and store them; reuse them when stored.
    ``seqs`` is a sequence table, or rows (workitem, cls, obs)."""
    spark = seqs.sparkSession
    path = os.path.join(work_dir, "folds")
    if not is_complete(spark, path):
        sample = hash_sample(seqs, params.sample_fraction, params.seed)
        if "rid" not in seqs.columns:
            # stored, as row ids are given out by the tasks; a workitem that
            # repeats or is null stays as many rows as it was
            sample = materialize(array_blocks(sample), "sample")
        write_folds(folded_sequences(sample, params.folds, params.seed, with_row_ids=True), path)
    return read_folds(spark, path)


def train(folded: DataFrame, params: RunParams, work_dir: str) -> DataFrame:
    """The trained models, stored once."""
    models_path = os.path.join(work_dir, "models")
    spark = folded.sparkSession
    if not is_complete(spark, models_path):
        models = train_models(folded, params.spec, params.folds, params.seed,
                              os.path.join(work_dir, "em"), params.epsilon, params.max_iterations,
                              feedback_duration=params.feedback_duration,
                              smoothing=params.smoothing, skip_undefined=params.skip_undefined)
        models.write.mode("overwrite").parquet(models_path)
    return spark.read.parquet(models_path)


def evaluate(folded: DataFrame, models: DataFrame, params: RunParams,
             t_prefix: int | list[int] | None = None) -> DataFrame:
    """Scores of every held-out sequence under both models of its fold."""
    return score_both(validation_rows(folded), models, params.spec, params.folds, t_prefix)


def _same_run(seqs: DataFrame, params: RunParams, work_dir: str, source: DataFrame | None) -> None:
    fingerprint = manifest.input_fingerprint(seqs if source is None else source)
    manifest.check(seqs.sparkSession, work_dir, manifest.describe(params, fingerprint))


def cross_validate(seqs: DataFrame, params: RunParams, work_dir: str, source: DataFrame | None = None) -> DataFrame:
    """V6 (flagship): metrics per fold (n, tp, fp, fn, tn, sensitivity,
    specificity, accuracy, error, n_undefined). ``seqs`` as in ``prepare_folds``;
    ``source`` is the table that it was built from, for the manifest."""
    spark = seqs.sparkSession
    _same_run(seqs, params, work_dir, source)
    folded = prepare_folds(seqs, params, work_dir)
    models = train(folded, params, work_dir)
    metrics_path = os.path.join(work_dir, "metrics")
    todo = pending_folds(spark, folded.select(F.col("kfold").alias("fold")).distinct(), metrics_path)
    folds = sorted(r.fold for r in todo.collect())  # at most k
    if folds:
        scores_path = os.path.join(work_dir, "scores")
        write_scores(evaluate(folded.where(F.col("kfold").isin(folds)), models, params), scores_path)
        scores = read_scores(spark, scores_path)
        append_metrics(fold_metrics(confusion_counts(scores.where(F.col("fold").isin(folds)))), metrics_path)
        audit.count_evaluated(folded, scores, work_dir)
    return spark.read.parquet(metrics_path)


def cross_validate_prefix(seqs: DataFrame, params: RunParams, work_dir: str,
                          prefixes: list[int] | None = None, source: DataFrame | None = None) -> DataFrame:
    """V7: metrics per (t_prefix, fold) with models and folds of a V6 run in
    ``work_dir`` (trained first when missing)."""
    spark = seqs.sparkSession
    _same_run(seqs, params, work_dir, source)
    prefixes = sorted(set(prefixes or [params.t_prefix]))
    folded = prepare_folds(seqs, params, work_dir)
    models = train(folded, params, work_dir)
    metrics_path, scores_path = os.path.join(work_dir, "prefix_metrics"), os.path.join(work_dir, "prefix_scores")
    folds = folded.select(F.col("kfold").alias("fold")).distinct()
    lengths = F.explode(F.array(*[F.lit(t) for t in prefixes])).alias("t_prefix")
    todo = pending_folds(spark, folds.select("fold", lengths), metrics_path, ["t_prefix", "fold"]).collect()  # lengths x k
    if todo:
        wanted = sorted({r.t_prefix for r in todo})
        unscored = wanted
        if has_partitions(spark, scores_path):
            # a length with a missing part is scored anew
            parts = folded.select(F.col("kfold").alias("fold"), "cls").distinct()
            saved = read_scores(spark, scores_path).select("t_prefix", "fold", "cls").distinct()
            missing = parts.select("fold", "cls", lengths).join(saved, ["t_prefix", "fold", "cls"], "left_anti")
            unscored = sorted({r.t_prefix for r in missing.select("t_prefix").distinct().collect()} & set(wanted))
        if unscored:
            write_scores(evaluate(folded, models, params, unscored), scores_path)
        scores = read_scores(spark, scores_path).where(F.col("t_prefix").isin(wanted))
        append_metrics(fold_metrics(confusion_counts(scores, ["t_prefix", "fold"])), metrics_path)
    return spark.read.parquet(metrics_path).where(F.col("t_prefix").isin(prefixes))
