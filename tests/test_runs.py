"""Work folders: manifest, accounts of rows, lifetime of tables."""
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from segstate.plans import audit
from segstate.plans import catalog as C
from segstate.plans.crossval import cross_validate, cross_validate_prefix
from segstate.plans.jobs import cross_validation, prefix_evaluation
from segstate.session import WorkScope, ensure_checkpoint_dir, materialize, new_work_dir
from segstate.sources import files, manifest
from segstate.sources.store import read_raw_lines
from segstate.spec import HsmmSpec, RunParams
from tests.conftest import SF_SMALL

PARAMS = RunParams(spec=HsmmSpec(m=2, k=4, d=3), folds=2, max_iterations=1)
OTHER = {"spec": [HsmmSpec(m=3, k=4, d=3), HsmmSpec(m=2, k=5, d=3), HsmmSpec(m=2, k=4, d=4)], "folds": [3], "seed": [7],
         "sample_fraction": [0.5], "epsilon": [1e-3], "max_iterations": [2], "feedback_duration": [True], "smoothing": [0.1],
         "skip_undefined": [True]}


def _seqs(spark, n=24):
    rows = [(f"w{i // 2}", i % 2, [i % 4, (i * 5) % 4, (i // 3) % 4, 1]) for i in range(n)]
    return spark.createDataFrame(rows, "workitem string, cls int, obs array<int>")


@pytest.fixture(scope="module")
def done(spark):
    work, seqs = new_work_dir(spark, "run"), materialize(_seqs(spark), "in")
    cross_validate(seqs, PARAMS, work)
    return work, seqs


@pytest.mark.parametrize("change", [{k: v} for k, vs in OTHER.items() for v in vs], ids=str)
def test_each_parameter_is_compared(done, change):
    work, seqs = done
    with pytest.raises(manifest.ManifestMismatch):
        cross_validate(seqs, replace(PARAMS, **change), work)
    with pytest.raises(manifest.ManifestMismatch):
        cross_validate_prefix(seqs, replace(PARAMS, **change), work, [2])


def test_input_is_compared(spark, done):
    work, seqs = done
    with pytest.raises(manifest.ManifestMismatch, match="input"):
        cross_validate(materialize(_seqs(spark, 26), "in"), PARAMS, work)
    # the same files through another plan are the same input
    assert cross_validate(seqs.where("cls >= 0"), PARAMS, work, seqs).count() == 2


def test_prefix_metrics_are_kept(spark, done, monkeypatch):
    work, seqs = done
    first = sorted(map(str, cross_validate_prefix(seqs, PARAMS, work, [1, 2]).collect()))
    import segstate.plans.crossval as CV
    scored = []
    real = CV.evaluate
    monkeypatch.setattr(CV, "evaluate", lambda *a: scored.append(a[3]) or real(*a))
    assert sorted(map(str, cross_validate_prefix(seqs, PARAMS, work, [1, 2]).collect())) == first and not scored
    more = cross_validate_prefix(seqs, PARAMS, work, [2, 3])
    assert scored == [[3]] and sorted((r.t_prefix, r.fold) for r in more.collect()) == [(2, 0), (2, 1), (3, 0), (3, 1)]
    # metrics of one fold are gone: only they come again, from the saved scores
    files.delete(spark, f"{work}/prefix_metrics/t_prefix=2/fold=1")
    again = sorted(map(str, cross_validate_prefix(seqs, PARAMS, work, [1, 2]).collect()))
    assert again == first and scored == [[3]]


def test_malformed_lines_are_counted(spark):
    base, work = new_work_dir(spark, "csv"), new_work_dir(spark, "cv")
    good = [f"w{i},{i % 4};1;{(i * 3) % 4}" for i in range(12)]
    files.write(spark, f"{base}/c1/a.csv", "\n".join([*good, "w3,0;1", "short", "long,0;1,more", "null,", ",0;1", "far,0;9", "text,0;x"]).encode())
    files.write(spark, f"{base}/c0/a.csv", "\n".join([*good, "w3"]).encode())
    lines = read_raw_lines(spark, {1: f"{base}/c1", 0: f"{base}/c0"})
    assert sorted(r.raw for r in lines.where("raw is not null").collect()) == ["long,0;1,more", "short", "w3"]
    got = cross_validation(spark, f"{base}/c1", f"{base}/c0", PARAMS, work)
    assert sorted(r.n for r in got.collect()) == [12, 13]
    rejected = spark.read.parquet(f"{work}/rejected")
    assert {(r.raw, r.reason) for r in rejected.where("reason = 'malformed line'").collect()} == {
        ("short", "malformed line"), ("long,0;1,more", "malformed line"), ("w3", "malformed line")}
    account = {(r.cls, r.name): r.n for r in audit.read(spark, work).where("stage = 'input'").collect()}
    assert account == {(1, "read"): 19, (0, "read"): 13, (1, "kept"): 13, (0, "kept"): 12, (1, "rejected: malformed line"): 2,
                       (0, "rejected: malformed line"): 1, (1, "rejected: no observation"): 1, (1, "rejected: no id"): 1,
                       (1, "rejected: symbol out of range"): 2, (1, "repeated ids"): 1, (0, "repeated ids"): 0}
    assert audit.lost(audit.read(spark, work)).isEmpty()
    # the same ids stand in both classes, one twice: nothing is joined, nothing lost
    held = audit.read(spark, work).where("stage = 'evaluated'").groupBy("name").agg(F.sum("n").alias("n")).collect()
    assert {(r.name, r.n) for r in held} == {("held out", 25), ("scored", 25)}
    assert prefix_evaluation(spark, f"{base}/c1", f"{base}/c0", work, [2], PARAMS).count() == 2


def test_lost_rows_show(spark):
    work = new_work_dir(spark, "audit")
    folded = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (0, 1, 0)], "cls int, kfold int, t0 long")
    audit.count_evaluated(folded, spark.createDataFrame([(1, 0), (0, 1)], "cls int, fold int"), work)
    assert [tuple(r) for r in audit.lost(audit.read(spark, work)).collect()] == [(1, 0, 2, 1)]


def _tables(spark):
    return set(files.names(spark, os.path.join(ensure_checkpoint_dir(spark), "segstate")))


@pytest.mark.parametrize("name", ["build_sequences", "score_both_models", "em_one_iteration", "source_sequences", "row_ids"])
def test_only_the_result_stays(spark, name):
    before = _tables(spark)
    got = C.QUERIES[name](spark, SF_SMALL)
    left = _tables(spark) - before
    assert len(left) == 1 and left.pop().startswith("result-") and got.count() > 0


def test_tables_go_after_a_failure(spark, monkeypatch):
    before = _tables(spark)

    def broken(*_):
        raise RuntimeError("stop")
    monkeypatch.setattr(C, "score_both", broken)
    with pytest.raises(RuntimeError):
        C.QUERIES["score_both_models"](spark, SF_SMALL)
    assert _tables(spark) == before and not WorkScope._open


def test_scopes_nest(spark):
    with WorkScope(spark) as outer:
        a = new_work_dir(spark, "a")
        with WorkScope(spark) as inner:
            b, c = materialize(spark.range(3), "b"), materialize(spark.range(4), "c")
            kept = inner.result(b.union(c))
        assert kept.count() == 7 and outer.paths == [a]
        assert outer.result(spark.range(2)).count() == 2
    assert not WorkScope._open
