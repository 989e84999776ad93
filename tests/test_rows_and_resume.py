"""Every input row is accounted for; interrupted and partial runs are redone."""
import os
from dataclasses import replace

import pytest

from segstate.plans import catalog as C
from segstate.plans.crossval import cross_validate_prefix, prepare_folds
from segstate.plans.em import train_models
from segstate.plans.jobs import usable
from segstate.session import ensure_checkpoint_dir, new_work_dir
from segstate.sources.store import read_folds
from segstate.spec import HsmmSpec, RunParams
from tests.conftest import SF_SMALL


def test_rows_kept_and_rejected(spark):
    rows = [(f"w{i % 9}", i % 2, [i % 4, 1]) for i in range(40)] + [
        (None, 0, [1]), ("e", 1, []), ("n", 1, None), ("s", 0, [9]), ("x", 1, [None])]
    seqs = spark.createDataFrame(rows, "workitem string, cls int, obs array<int>")
    params, work = RunParams(folds=3), new_work_dir(spark, "rows")
    good = usable(seqs, params, work)
    folds = prepare_folds(good, params, work)
    assert folds.count() == 40 and folds.select("cls", "row_id").distinct().count() == 40
    reasons = [r[0] for r in spark.read.parquet(f"{work}/rejected").select("reason").collect()]
    assert sorted(reasons) == ["no id", "no observation", "no observation", "symbol out of range", "symbol out of range"]


def test_unfinished_folder_is_redone(spark):
    seqs = C.d2_lines(spark, SF_SMALL)
    work = new_work_dir(spark, "half")
    os.makedirs(os.path.join(work.removeprefix("file:"), "folds", "_temporary"))
    assert prepare_folds(seqs, RunParams(), work).count() == seqs.count()


def test_partial_prefix_scores_and_wrong_spec(spark):
    seqs, params = C.d2(spark, SF_SMALL), replace(C.RUN, max_iterations=1)
    work = new_work_dir(spark, "part")
    want = sorted(map(str, cross_validate_prefix(seqs, params, work, [2]).collect()))
    scores = spark.read.parquet(f"{work}/prefix_scores").where("fold = 0")
    other = new_work_dir(spark, "part")
    read_folds(spark, f"{work}/folds").write.partitionBy("cls", "kfold").parquet(f"{other}/folds")
    spark.read.parquet(f"{work}/models").write.parquet(f"{other}/models")
    scores.write.partitionBy("t_prefix", "fold", "cls").parquet(f"{other}/prefix_scores")
    assert sorted(map(str, cross_validate_prefix(seqs, params, other, [2]).collect())) == want and len(want) == 5


def test_training_ends_converged_or_diverged(spark):
    models = C.QUERIES["em_train_converged"](spark, SF_SMALL).collect()
    assert len(models) == 10 and {r.status for r in models} <= {"converged", "diverged"}
    assert max(r.iteration for r in models) > 3


def test_undefined_model_stops(spark):
    """A symbol that no state emits makes the parameters NaN (Q10)."""
    rows = [(f"w{i}", 0, [i % 2, 3, 1, 0], i % 2) for i in range(8)]
    folded = spark.createDataFrame(rows, "workitem string, cls int, obs array<int>, kfold int")
    half = [[0.5, 0.5, 0.0, 0.0]] * 2
    start = spark.createDataFrame([(f, 0, 2, 4, 3, [0.5, 0.5], [[0.5, 0.5]] * 2, half, [[0.1, 0.2, 0.2]] * 2) for f in (0, 1)],
                                  "fold int, cls int, m int, k int, d int, pi array<double>, a array<array<double>>,"
                                  " b array<array<double>>, p array<array<double>>")
    got = train_models(folded, HsmmSpec(m=2, k=4, d=3), 2, 1, new_work_dir(spark, "nan"), start=start).collect()
    assert {r.status for r in got} == {"diverged"} and max(r.iteration for r in got) < 3


def test_shared_folder_is_required(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: type("Conf", (), {"get": staticmethod(lambda k, d=None: d)}))

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(Session())
