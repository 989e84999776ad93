"""Scoring under two models and the confusion metrics.

Instead of scoring a split twice and joining the two results on workitem,
every validation row gets both scores in the same pass (``scoring``), so an id
that occurs in both classes never mixes. The confusion counts of all folds are
one ``groupBy(fold)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstate.functions.arrays import ieee_div
from segstate.operators.scoring import model_params, prefix_scores
from segstate.spec import HsmmSpec


def score_both(valid: DataFrame, models: DataFrame | dict, spec: HsmmSpec, n_folds: int,
               t_prefix: int | list[int] | None = None) -> DataFrame:
    """V1/V2 + V3: (workitem, cls, fold, score1, score0) for rows with ``fold``.
    A list of prefix lengths scores all of them in one pass and adds the column
    ``t_prefix``. Models that are too large to travel with the tasks are joined
    to the symbols instead (``wide``)."""
    lengths = t_prefix if isinstance(t_prefix, list) else [t_prefix]
    params = models if isinstance(models, dict) else model_params(models, spec)
    if params is None:
        from segstate.operators.wide import wide_scores
        scores = wide_scores(valid, models, spec, lengths)
    else:
        scores = prefix_scores(valid, params, spec, lengths)
    return scores if isinstance(t_prefix, list) else scores.drop("t_prefix")


def predict(score1: Column, score0: Column) -> Column:
    """Class 1 when score1 > score0 (Spark order: NaN above numbers); ties -> 0."""
    return F.when(score1 > score0, F.lit(1)).otherwise(F.lit(0))


def confusion_counts(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V4: n, tp, fp, fn, tn per fold (and any extra key such as t_prefix)."""
    keys = keys or ["fold"]
    pred = predict(F.col("score1"), F.col("score0"))
    pos = F.col("cls") == 1

    def count_if(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return scores.groupBy(*keys).agg(
        F.count("*").alias("n"),
        count_if(pos & (pred == 1)).alias("tp"),
        count_if(~pos & (pred == 1)).alias("fp"),
        count_if(pos & (pred == 0)).alias("fn"),
        count_if(~pos & (pred == 0)).alias("tn"),
        count_if(F.isnan("score1") | F.isnan("score0")).alias("n_undefined"),
    )


def fold_metrics(counts: DataFrame) -> DataFrame:
    """V5: sensitivity, specificity, accuracy, error (0/0 -> NaN)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    acc = ieee_div(tp + tn, tp + fp + fn + tn)
    return counts.select(
        "*",
        ieee_div(tp, tp + fn).alias("sensitivity"),
        ieee_div(tn, tn + fp).alias("specificity"),
        acc.alias("accuracy"),
        (F.lit(1.0) - acc).alias("error"),
    )
