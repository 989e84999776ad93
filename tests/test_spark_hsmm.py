"""Spark paths against the hand goldens and against the numpy kernel."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstate.functions.obs import parse_obs
from segstate.operators import kernel as K
from segstate.operators.evaluate import confusion_counts, fold_metrics
from segstate.operators.forward import forward_score, score_sequences
from segstate.plans.em import read_trace, train_models
from segstate.session import new_work_dir
from segstate.spec import HsmmSpec
from tests.fixtures import A, B0, B1, EM_TRACE, P, PI0, PI1, SCORES, SEQS, col_major

SPEC3 = HsmmSpec(m=2, k=3, d=3)
MODEL_SCHEMA = ("fold int, cls int, m int, k int, d int, pi array<double>, "
                "a array<array<double>>, b array<array<double>>, p array<array<double>>")


def _models(spark):
    return spark.createDataFrame([(0, 1, 2, 3, 3, PI1, A, B1, P), (0, 0, 2, 3, 3, PI0, A, B0, P)],
                                 MODEL_SCHEMA)


def _seqs(spark, kfold=1):
    rows = [(f"w{i}", s, 1, kfold) for i, s in enumerate(SEQS)]
    df = spark.createDataFrame(rows, "workitem string, str_obs string, cls int, kfold int")
    return df.withColumn("obs", parse_obs(F.col("str_obs")))


def test_forward_expression_goldens(spark):
    seqs = _seqs(spark).withColumn("fold", F.lit(0))
    m1 = _models(spark).where("cls = 1")
    full = {r.str_obs: r.score for r in score_sequences(seqs, m1.drop("cls"), SPEC3, ["fold"]).collect()}
    pre = {r.str_obs: r.score for r in
           score_sequences(seqs, m1.drop("cls"), SPEC3, ["fold"], t_prefix=2).collect()}
    for s, (s1, _, s1p) in SCORES.items():
        assert full[s] == pytest.approx(s1, abs=1e-8)
        assert pre[s] == pytest.approx(s1p, abs=1e-8)


def test_prefix_longer_than_sequence_is_full_score(spark):
    seqs = _seqs(spark).withColumn("fold", F.lit(0))
    m1 = _models(spark).where("cls = 1").drop("cls")
    a = {r.workitem: r.score for r in score_sequences(seqs, m1, SPEC3, ["fold"]).collect()}
    b = {r.workitem: r.score for r in score_sequences(seqs, m1, SPEC3, ["fold"], t_prefix=100).collect()}
    assert a == b


def test_expression_matches_kernel_on_events(spark):
    from segstate.plans.catalog import SPEC, folded, start_models
    from tests.conftest import SF_SMALL
    fld = folded(spark, SF_SMALL).withColumn("fold", F.col("kfold"))
    models = start_models(fld).where("cls = 1").drop("cls")
    scored = score_sequences(fld, models, SPEC, ["fold"]).join(
        models.withColumnRenamed("fold", "kfold"), "kfold").collect()
    assert len(scored) > 0
    for r in scored:
        want = K.score(np.array([r.obs]), np.array([r.pi]), np.array([r.a]), np.array([r.b]),
                       np.array([r.p]))[0]
        assert r.score == pytest.approx(want, abs=1e-9)


def test_em_three_iterations_golden(spark):
    """FIXTURES 2.3: three EM iterations on the six sequences from m1."""
    folded = _seqs(spark, kfold=1)
    start = _models(spark).where("cls = 1")
    work = new_work_dir(spark, "test-em")
    train_models(folded, SPEC3, 2, 42, work, epsilon=1e-12, max_iterations=3, start=start)
    trace = {r.iteration: r for r in read_trace(spark, work).collect()}
    assert sorted(trace) == [0, 1, 2]
    for it, (ll, pi, a, b, p) in enumerate(EM_TRACE):
        r = trace[it]
        assert r.loglik == pytest.approx(ll, abs=1e-7)
        np.testing.assert_allclose(r.pi, pi, atol=1e-7)
        np.testing.assert_allclose(col_major(r.a), a, atol=1e-7)
        np.testing.assert_allclose(col_major(r.b), b, atol=1e-7)
        np.testing.assert_allclose(col_major(r.p), p, atol=1e-7)


def test_em_resume_equals_straight_run(spark):
    folded = _seqs(spark, kfold=1)
    start = _models(spark).where("cls = 1")
    w1, w2 = new_work_dir(spark, "t-straight"), new_work_dir(spark, "t-resume")
    straight = train_models(folded, SPEC3, 2, 42, w1, 1e-12, 3, start=start).first()
    train_models(folded, SPEC3, 2, 42, w2, 1e-12, 1, start=start)
    resumed = train_models(folded, SPEC3, 2, 42, w2, 1e-12, 3).first()
    assert resumed.iteration == straight.iteration == 2
    np.testing.assert_allclose(resumed.pi, straight.pi, atol=1e-12)
    np.testing.assert_allclose(np.array(resumed.b), np.array(straight.b), atol=1e-12)


def test_confusion_counts_add_up(spark):
    from segstate.plans.catalog import scores_start
    from tests.conftest import SF_SMALL
    m = fold_metrics(confusion_counts(scores_start(spark, SF_SMALL))).collect()
    assert len(m) == 5
    for r in m:
        assert r.tp + r.fp + r.fn + r.tn == r.n
        assert r.accuracy + r.error == pytest.approx(1.0)


def test_flagship_entry(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2, 3, 4]
    assert all(r.tp + r.fp + r.fn + r.tn == r.n for r in rows)
