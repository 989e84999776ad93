"""The queries that train to the end against the numpy kernel, on a small fixture."""
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from segstate.functions.params import init_model_values
from segstate.operators import kernel as K
from segstate.plans import catalog as C

SCHEMA = "workitem string, cls int, obs array<int>"
SEED = 2
EPSILON = 2e-3  # a wider stop test than the default, for a short run


def _rows():
    rng = random.Random(SEED)
    return [(f"w{i}", i % 2, [rng.choice((0, 1, 1, 2, 3) if i % 2 else (0, 0, 1, 2, 3)) for _ in range(rng.randrange(3, 7))])
            for i in range(40)]


def _train(obs, fold, cls):
    """Trace [(loglik, pi, a, b, p)] of plain EM, to the stop test."""
    v = init_model_values(fold, cls, C.SPEC, C.SEED)
    pi, a, b, start = (np.array(v[x], dtype=float) for x in ("pi", "a", "b", "p"))
    out, prev = [], -np.inf
    while len(out) < 60:
        parts = [K.e_step(np.array([o]), C.SPEC.k, pi[None], a[None], b[None], start[None]) for o in obs]
        ll, pi, a, b, p = (sum(np.asarray(x[i])[0] for x in parts) for i in range(5))
        pi, a, b, p = K.l1(pi), K.l1(a), K.l1(b), p / p.sum()  # cells can be negative
        out.append((ll, pi, a, b, p))
        if abs(ll - prev) / ((abs(ll) + abs(prev)) / 2) < EPSILON:
            return out
        prev = ll
    raise AssertionError("not converged")


@pytest.fixture(scope="module")
def small(spark):
    seqs = spark.createDataFrame(_rows(), SCHEMA)
    fold = {r.workitem: r.kfold for r in C.FO.assign_folds(seqs, C.K_FOLDS, C.SEED).collect()}
    traces = {(f, c): _train([o for w, k, o in _rows() if k == c and fold[w] != f], f, c)
              for f in range(C.K_FOLDS) for c in (0, 1)}
    return seqs, fold, traces


@pytest.fixture(autouse=True)
def short(monkeypatch):
    monkeypatch.setattr(C, "RUN", replace(C.RUN, epsilon=EPSILON))


def test_trace_resume_to_the_end(spark, small, monkeypatch):
    seqs, _, traces = small
    monkeypatch.setattr(C, "folded", lambda *_: C.FO.assign_folds(seqs, C.K_FOLDS, C.SEED))
    rows = C.QUERIES["trace_resume_converged"](spark, "").collect()
    assert Counter((r.fold, r.cls) for r in rows) == {k: len(t) for k, t in traces.items()}
    assert max(r.iteration for r in rows) > 3
    for r in rows:
        ll, *params = traces[r.fold, r.cls][r.iteration]
        assert r.loglik == pytest.approx(ll, abs=1e-3)
        for got, want in zip((r.pi, r.a, r.b, r.p), params, strict=True):
            np.testing.assert_allclose(np.array(got), want, atol=2e-6)
    assert {(r.fold, r.cls) for r in rows if r.status == "converged"} == set(traces)


def test_prefix_validation_of_converged_models(spark, small, monkeypatch):
    seqs, fold, traces = small
    monkeypatch.setattr(C, "d2", lambda *_: seqs)
    got = {(r.t_prefix, r.fold): (r.tp, r.fp, r.fn, r.tn)
           for r in C.QUERIES["cross_validate_prefix_converged"](spark, "").collect()}
    want = {}
    for w, cls, obs in _rows():
        for t in (1, 2, C.T_PREFIX):
            s = [K.score(np.array([obs[:t]]), *(x[None] for x in traces[fold[w], c][-1][1:]))[0] for c in (0, 1)]
            cell = want.setdefault((t, fold[w]), [0, 0, 0, 0])
            cell[(0 if cls else 1) if s[1] > s[0] else (2 if cls else 3)] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_trained_models_have_parameters(spark, small, monkeypatch):
    seqs, _, traces = small
    monkeypatch.setattr(C, "folded", lambda *_: C.FO.assign_folds(seqs, C.K_FOLDS, C.SEED))
    r = C.QUERIES["em_train_converged"](spark, "").where("fold = 0 and cls = 1").first()
    np.testing.assert_allclose(np.array(r.b), traces[0, 1][-1][3], atol=2e-6)
