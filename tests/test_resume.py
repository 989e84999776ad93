"""Re-running a job on its work folder after a failure gives the same result."""
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from segstate.plans import catalog as C
from segstate.plans import em
from segstate.plans.crossval import cross_validate, evaluate, prepare_folds, train
from segstate.session import new_work_dir
from segstate.sources import files
from segstate.sources.store import write_scores
from tests.conftest import SF_SMALL


def _metrics(df):
    return sorted((r.fold, r.n, r.tp, r.fp, r.fn, r.tn) for r in df.collect())


def test_crash_after_scores_before_metrics(spark):
    seqs, params = C.d2(spark, SF_SMALL), replace(C.RUN, max_iterations=2)
    clean = _metrics(cross_validate(seqs, params, new_work_dir(spark, "clean")))
    work = new_work_dir(spark, "crashed")
    folded = prepare_folds(seqs, params, work)
    models = train(folded, params, work)
    # scores of folds 0 and 1 were written, then the driver died
    partial = evaluate(folded.where(F.col("kfold") < 2), models, params)
    write_scores(partial, os.path.join(work, "scores"))
    assert _metrics(cross_validate(seqs, params, work)) == clean
    # and a second run on the finished folder changes nothing
    assert _metrics(cross_validate(seqs, params, work)) == clean


def test_killed_between_data_and_log(spark, monkeypatch):
    """The rows of iteration 2 are written, its log row is not: the resume does
    the iteration again and ends where a run without a break ends."""
    rows = [(f"w{i}", i % 2, [i % 4, (i * 7) % 4, (i // 2) % 4, 1], i % 3) for i in range(40)]
    folded = spark.createDataFrame(rows, "workitem string, cls int, obs array<int>, kfold int")
    spec, whole, cut = C.SPEC, new_work_dir(spark, "whole"), new_work_dir(spark, "cut")
    want = sorted(map(str, em.train_models(folded, spec, 3, 1, whole, 1e-9, 4).collect()))
    write = files.write_json

    def killed(spark, path, value):
        if value.get("iteration") == 2:
            raise KeyboardInterrupt
        write(spark, path, value)
    monkeypatch.setattr(files, "write_json", killed)
    with pytest.raises(KeyboardInterrupt):
        em.train_models(folded, spec, 3, 1, cut, 1e-9, 4)
    assert "rows-000002.parquet" in files.names(spark, f"{cut}/trace")
    assert [r.iteration for r in em.read_log(spark, cut)] == [0, 1]
    assert em.read_trace(spark, cut).agg(F.max("iteration")).first()[0] == 1
    monkeypatch.undo()
    # a log row that was cut short before its rename does not count either
    files.write(spark, f"{cut}/trace/log/000002.json._part", b'{"iteration": 2, "pa')
    assert sorted(map(str, em.train_models(folded, spec, 3, 1, cut, 1e-9, 4).collect())) == want
    assert [r.iteration for r in em.read_log(spark, cut)] == [0, 1, 2, 3]


def test_symbol_out_of_range_is_rejected(spark):
    from segstate.functions.obs import parse_obs
    rows = [(f"w{i}", 1 if i % 2 else 0, s) for i, s in enumerate(["0;1", "1;2", "0;7", "2;2", "1;0", "3;1"] * 4)]
    seqs = spark.createDataFrame(rows, "workitem string, cls int, str_obs string").select(
        "workitem", "cls", parse_obs(F.col("str_obs")).alias("obs"))
    with pytest.raises(Exception) as err:
        cross_validate(seqs, C.RUN, new_work_dir(spark, "badsym")).collect()
    assert "outside [0, 4)" in str(err.value)
