"""Models above the limit for tables that travel with the tasks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from segstate.operators import folds as FO
from segstate.operators.estep import e_step_stats_folded
from segstate.operators.evaluate import score_both
from segstate.plans import em
from segstate.session import new_work_dir
from tests.test_blocks import SPEC, _same, _stats, tables  # noqa: F401


@pytest.fixture
def limit(spark):
    """The limit set to 1 KB: no model table of these fits."""
    spark.conf.set("segstate.modelBroadcastLimit", "1024")
    yield
    spark.conf.unset("segstate.modelBroadcastLimit")


def _nonzero(stats):
    return {k: v for k, v in stats.items() if v or k[2] != "b"}


@pytest.mark.parametrize("cut", [0, 1])
def test_sums(spark, tables, limit, cut):  # noqa: F811
    models = tables[2]
    wide = _stats(e_step_stats_folded(tables[cut], models, SPEC, 3))
    spark.conf.unset("segstate.modelBroadcastLimit")
    _same(_nonzero(_stats(e_step_stats_folded(tables[0], models, SPEC, 3))), _nonzero(wide))


@pytest.mark.parametrize("cut", [0, 1])
def test_scores(spark, tables, limit, cut):  # noqa: F811
    def scores(df):
        return sorted((r.workitem, r.cls, r.t_prefix or 0, round(r.score1, 9), round(r.score0, 9))
                      for r in score_both(FO.validation_rows(df), tables[2], SPEC, 3, [2, 6]).collect())
    wide = scores(tables[cut])
    spark.conf.unset("segstate.modelBroadcastLimit")
    assert wide == scores(tables[0])


@pytest.mark.parametrize("smoothing", [0.0, 0.01])
def test_training_and_resume(spark, tables, limit, smoothing):  # noqa: F811
    work = new_work_dir(spark, "wide")
    em.train_models(tables[1], SPEC, 3, 4, work, 1e-4, 1, smoothing=smoothing)
    wide = em.train_models(tables[1], SPEC, 3, 4, work, 1e-4, 3, smoothing=smoothing).orderBy("fold", "cls").collect()
    spark.conf.unset("segstate.modelBroadcastLimit")
    plain = em.train_models(tables[0], SPEC, 3, 4, new_work_dir(spark, "plain"), 1e-4, 3, smoothing=smoothing).orderBy("fold", "cls").collect()
    for x, y in zip(wide, plain, strict=True):
        assert (x.iteration, x.status) == (y.iteration, y.status) and x.loglik == pytest.approx(y.loglik, rel=1e-9)
        for c in ("pi", "a", "b", "p"):
            np.testing.assert_allclose(np.array(x[c]), np.array(y[c]), rtol=1e-7, atol=1e-12)


def test_symbol_out_of_range(tables, limit):  # noqa: F811
    bad = tables[0].withColumn("obs", F.array(F.lit(9)))
    with pytest.raises(Exception, match="outside"):
        e_step_stats_folded(bad, tables[2], SPEC, 3).collect()


def test_symbol_that_no_model_emits(spark, tables, limit):  # noqa: F811
    """Cells that are absent count as zero, in every model or in some."""
    from segstate.operators import wide
    models = tables[2]
    params, cells = wide.small_params(models), wide.emission_cells(models)
    some = cells.where("not (sym = 2 and fold = 1) and sym <> 4")
    zeroed = models.withColumn("b", F.transform("b", lambda row: F.transform(row, lambda x, v: F.when(
        (v == 4) | ((v == 2) & (F.col("fold") == 1)), 0.0).otherwise(x))))
    got = _nonzero(_stats(wide.wide_sums(tables[1], params, some, SPEC, skip_undefined=True)))
    spark.conf.unset("segstate.modelBroadcastLimit")
    _same(_nonzero(_stats(e_step_stats_folded(tables[0], zeroed, SPEC, 3, skip_undefined=True))), got)
