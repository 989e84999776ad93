"""Non-default EM options: smoothing, duration feedback, skipping undefined rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from segstate.functions.obs import parse_obs
from segstate.operators import kernel as K
from segstate.plans.em import read_trace, train_models
from segstate.session import new_work_dir
from segstate.spec import HsmmSpec
from tests.fixtures import A, B1, P, PI1, SEQS, parse

SPEC3 = HsmmSpec(m=2, k=3, d=3)
SCHEMA = ("fold int, cls int, m int, k int, d int, pi array<double>, a array<array<double>>, "
          "b array<array<double>>, p array<array<double>>")


def _folded(spark, seqs):
    rows = [(f"w{i}", s, 1, 1) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "workitem string, str_obs string, cls int, kfold int")
    return df.withColumn("obs", parse_obs(F.col("str_obs")))


def _numpy_em(seqs, pi, a, b, p, iters, smoothing=0.0, feedback=False, skip=False):
    p_e = np.asarray(p, float)
    pi, a, b = (np.asarray(x, float) for x in (pi, a, b))
    out = []
    for _ in range(iters):
        sums = [0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3)), np.zeros((2, 3))]
        n_bad = 0
        for s in seqs:
            r = K.e_step(np.array([parse(s)]), 3, pi[None], a[None], b[None], p_e[None])
            if skip and any(np.isnan(x).any() for x in r[1:]):
                n_bad += 1
                continue
            for i in range(5):
                sums[i] = sums[i] + r[i][0]
        pi = K.l1(sums[1] + smoothing)
        a = K.l1(sums[2] + smoothing, axis=1)
        b = K.l1(sums[3] + smoothing, axis=1)
        pn = sums[4] + smoothing
        pn = pn * (1.0 / pn.sum())
        out.append((sums[0], pi, a, b, pn, n_bad))
        if feedback:
            p_e = pn
    return out


def _check(spark, seqs, start_b, iters, **opts):
    start = spark.createDataFrame([(0, 1, 2, 3, 3, PI1, A, start_b, P)], SCHEMA)
    work = new_work_dir(spark, "opt")
    train_models(_folded(spark, seqs), SPEC3, 2, 42, work, 1e-12, iters, start=start, **opts)
    trace = {r.iteration: r for r in read_trace(spark, work).collect()}
    want = _numpy_em(seqs, PI1, A, start_b, P, iters, opts.get("smoothing", 0.0),
                     opts.get("feedback_duration", False), opts.get("skip_undefined", False))
    for it, (ll, pi, a, b, p, n_bad) in enumerate(want):
        r = trace[it]
        assert r.loglik == pytest.approx(ll, abs=1e-9)
        np.testing.assert_allclose(r.pi, pi, atol=1e-9)
        np.testing.assert_allclose(np.array(r.a), a, atol=1e-9)
        np.testing.assert_allclose(np.array(r.b), b, atol=1e-9)
        np.testing.assert_allclose(np.array(r.p), p, atol=1e-9)
        assert r.n_undefined >= n_bad
    return trace


def test_smoothing(spark):
    _check(spark, SEQS, B1, 2, smoothing=2.0 ** -52)


def test_duration_feedback(spark):
    t = _check(spark, SEQS, B1, 3, feedback_duration=True)
    frozen = _check(spark, SEQS, B1, 3)
    assert t[2].loglik != frozen[2].loglik


def test_skip_undefined(spark):
    b_zero = [[.5, .5, 0.0], [.5, .5, 0.0]]
    seqs = ["0;1", "1;0;1", "0;2;0"]  # the last one is impossible: 0/0 estimates
    t = _check(spark, seqs, b_zero, 1, skip_undefined=True)
    assert t[0].n_undefined == 1
    assert np.isfinite(np.array(t[0].a)).all()
    poisoned = _check(spark, seqs, b_zero, 1)
    assert np.isnan(np.array(poisoned[0].a)).all()
