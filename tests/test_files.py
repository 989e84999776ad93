"""Text files: folds as CSV and models with a header, by fold."""
import pytest

from segstate.plans import catalog as C
from segstate.session import new_work_dir
from segstate.sources import blocks as BL
from segstate.sources import store as ST
from segstate.sources.events import hash_sample
from segstate.operators import folds as FO
from segstate.spec import HsmmSpec
from tests.conftest import SF_SMALL
from pyspark.sql import functions as F


def test_folds_csv_round_trip(spark):
    fld = BL.arrays(C.folded(spark, SF_SMALL, with_row_ids=True), ["row_id", "kfold"])
    base = new_work_dir(spark, "foldscsv")
    paths = {c: f"{base}/class{c}" for c in (0, 1)}
    for c, path in paths.items():
        ST.write_folds_csv(fld.where(F.col("cls") == c), path)
    cols = ["workitem", "cls", "obs", "row_id", "kfold"]
    back = ST.read_folds_csv(spark, paths)
    assert back.columns == cols
    assert sorted(map(str, back.collect())) == sorted(map(str, fld.select(cols).collect()))


def test_model_file(spark):
    models = C.start_models(C.folded(spark, SF_SMALL))
    base = new_work_dir(spark, "modelfile")
    paths = {c: f"{base}/class{c}" for c in (0, 1)}
    for c, path in paths.items():
        ST.write_model_file(models.where(F.col("cls") == c), path)
    text = [r.value for r in spark.read.text(paths[1]).collect()]
    assert text[0] == ST.MODEL_HEADER and [t.split(";")[0] for t in text[1:]] == list("01234")
    back = ST.read_model_file(spark, paths, C.SPEC)
    assert sorted(map(str, back.select(models.columns).collect())) == sorted(map(str, models.collect()))
    one = ST.read_model_file(spark, {1: paths[1]}, C.SPEC, fold=3).collect()
    assert [(r.fold, r.cls) for r in one] == [(3, 1)]
    with pytest.raises(Exception, match="dimensions"):
        ST.read_model_file(spark, paths, HsmmSpec(m=3, k=4, d=5)).collect()


def test_fold_buckets_stay_even_after_sampling(spark):
    ids = spark.range(200_000).select(F.col("id").cast("string").alias("workitem"))
    kept = hash_sample(ids, 0.05, 42).select(F.substring(FO.fold_order_key(42), 1, 2).alias("bucket"))
    assert kept.distinct().count() == 256
