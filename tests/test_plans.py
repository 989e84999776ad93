"""Plan properties that matter at scale, checked on the registered queries."""
import re

import pytest

from segstate.operators import folds as FO
from segstate.plans import catalog as C
from segstate.session import materialize
from segstate.sources import blocks
from tests.conftest import SF_SMALL

ITERATIVE = {n for n in C.QUERIES if n.startswith(("em_", "trace_", "cross_"))} | {"run_audit"}
# operators outside this package test their own plans
PLAIN = sorted(set(C.QUERIES) - ITERATIVE)


class Written:
    """The plans of all tables that a query writes on its way, and of its result."""

    def __init__(self, monkeypatch):
        from segstate.session import WorkScope
        self.plans = []
        for module in (blocks, C, FO):
            monkeypatch.setattr(module, "materialize", self.materialize)
        monkeypatch.setattr(WorkScope, "result", lambda scope, df: self.keep(df))

    def keep(self, df):
        self.plans.append(_plan(df))
        return df

    def materialize(self, df, name="table"):
        return materialize(self.keep(df), name)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cartesian_or_nested_loop(spark, name, monkeypatch):
    written = Written(monkeypatch)
    C.QUERIES[name](spark, SF_SMALL)
    assert written.plans
    for plan in written.plans:
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, name


def test_event_scan_is_pruned(spark, monkeypatch):
    """The plan that cuts the events into blocks, before it is stored."""
    seen = []

    def keep(df, name="table"):
        seen.append(df)
        return materialize(df, name)
    monkeypatch.setattr(blocks, "materialize", keep)
    C.d2(spark, SF_SMALL)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = seen[0]._jdf.queryExecution().explainString(mode)
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert schemas and "RangePartitioning" in _plan(seen[0]) or "rangepartitioning" in _plan(seen[0])
    for s in schemas:
        assert "props" not in s and "value" not in s, s


def test_fold_scan_prunes_partitions(spark):
    from pyspark.sql import functions as F

    from segstate.plans.catalog import folded
    from segstate.session import new_work_dir
    from segstate.sources.store import read_folds, write_folds
    import os
    path = os.path.join(new_work_dir(spark, "prune"), "folds")
    write_folds(folded(spark, SF_SMALL, with_row_ids=True), path)
    q = read_folds(spark, path).where(F.col("kfold") == 2)
    text = q._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(kfold" in text and "(kfold" in text
