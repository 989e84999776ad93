import numpy as np
import pytest
from pyspark.sql import functions as F

from segstate.operators import folds as FO
from segstate.operators.estep import e_step_stats_folded
from segstate.plans import catalog as C
from tests.conftest import SF_SMALL


def _stats(df):
    return {(r.fold, r.cls, r.param, r.i, r.j): r.value for r in df.collect()}


def test_estep_independent_of_partitioning(spark):
    fld = C.folded(spark, SF_SMALL)
    models = C.start_models(C.folded(spark, SF_SMALL))
    one = _stats(e_step_stats_folded(fld.coalesce(1), models, C.SPEC, C.K_FOLDS))
    many = _stats(e_step_stats_folded(fld.repartition(7), models, C.SPEC, C.K_FOLDS))
    assert set(one) == set(many)
    for k, v in one.items():
        assert many[k] == pytest.approx(v, rel=1e-10, abs=1e-10)


def test_salted_model_join_equals_broadcast(spark):
    from segstate.operators.forward import score_sequences
    fld = FO.validation_rows(C.folded(spark, SF_SMALL)).select("workitem", "fold", "obs")
    models = C.start_models(C.folded(spark, SF_SMALL)).where("cls = 1").drop("cls")
    want = {r.workitem: r.score for r in score_sequences(fld, models, C.SPEC, ["fold"]).collect()}
    spark.conf.set("segstate.modelBroadcastLimit", "1")
    try:
        salted = score_sequences(fld, models, C.SPEC, ["fold"])
        plan = salted._jdf.queryExecution().executedPlan().toString()
        got = {r.workitem: r.score for r in salted.collect()}
    finally:
        spark.conf.unset("segstate.modelBroadcastLimit")
    assert "_salt" in plan
    assert got == want


def test_trained_models_are_normalised(spark):
    m = C.q_em_one_iteration(spark, SF_SMALL).collect()
    cells = {}
    for r in m:
        cells.setdefault((r.fold, r.cls, r.param, r.i), []).append(r.value)
    per_model = {}
    for (f, c, param, i), vals in cells.items():
        if param in ("pi", "p"):
            per_model.setdefault((f, c, param), []).extend(vals)
        else:  # rows of A and B: L1 norm 1
            assert sum(abs(v) for v in vals) == pytest.approx(1.0, abs=1e-5)
    for (f, c, param), vals in per_model.items():
        assert sum(vals) == pytest.approx(1.0, abs=1e-5), (f, c, param)


def test_driver_start_model_equals_spark(spark):
    from segstate.functions.params import init_model_values, init_models
    keys = spark.createDataFrame([(3, 0), (0, 1)], "fold int, cls int")
    for r in init_models(keys, C.SPEC, 42).collect():
        mv = init_model_values(r.fold, r.cls, C.SPEC, 42)
        for x in ("pi", "a", "b", "p"):
            np.testing.assert_allclose(np.array(getattr(r, x)), np.array(mv[x]), rtol=0, atol=1e-15)
