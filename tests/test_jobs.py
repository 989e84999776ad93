"""End-to-end jobs from per-class CSV files, as the reference is run."""
import os
from dataclasses import replace

from pyspark.sql import functions as F

from segstate.plans import catalog as C
from segstate.plans.crossval import cross_validate, cross_validate_prefix
from segstate.plans.jobs import cross_validation, prefix_evaluation
from segstate.session import new_work_dir
from segstate.sources.store import write_raw_sequences
from tests.conftest import SF_SMALL


def test_jobs_from_csv_equal_dataframe_path(spark):
    d2, run = C.d2_lines(spark, SF_SMALL), replace(C.RUN, max_iterations=3)
    base = new_work_dir(spark, "csv")
    paths = {c: os.path.join(base, f"class{c}") for c in (0, 1)}
    for c, p in paths.items():
        write_raw_sequences(d2.where(F.col("cls") == c), p)
    work = new_work_dir(spark, "job")
    got = sorted(tuple(r) for r in cross_validation(spark, paths[1], paths[0], run, work)
                 .select("fold", "n", "tp", "fp", "fn", "tn").collect())
    want = sorted(tuple(r) for r in cross_validate(d2, run, new_work_dir(spark, "df"))
                  .select("fold", "n", "tp", "fp", "fn", "tn").collect())
    assert got == want
    pre = sorted(tuple(r) for r in prefix_evaluation(spark, paths[1], paths[0], work, [2], run)
                 .select("t_prefix", "fold", "tp", "tn").collect())
    want_pre = sorted(tuple(r) for r in cross_validate_prefix(d2, run, new_work_dir(spark, "dfp"), [2])
                      .select("t_prefix", "fold", "tp", "tn").collect())
    assert pre == want_pre
