from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from segstate.operators import folds as FO
from segstate.sources.events import labelled_sequences
from tests.conftest import SF_MID, SF_SMALL


def test_row_ids_equal_window(spark):
    d2 = labelled_sequences(spark, SF_MID)
    got = {(r.workitem, r.cls): r.row_id for r in FO.row_ids(d2).collect()}
    w = Window.partitionBy("cls").orderBy("workitem")
    want = {(r.workitem, r.cls): r.rn for r in d2.select("workitem", "cls", F.row_number().over(w).alias("rn")).collect()}
    assert got == want


def test_row_ids_independent_of_partitions(spark):
    d2 = labelled_sequences(spark, SF_SMALL)
    a = {r.workitem: r.row_id for r in FO.ordered_row_number(d2, "cls", ["workitem"], partitions=1).collect()}
    b = {r.workitem: r.row_id for r in FO.ordered_row_number(d2, "cls", ["workitem"], partitions=13).collect()}
    assert a == b


def test_folds_balanced_and_stratified(spark):
    d2 = labelled_sequences(spark, SF_MID)
    rows = FO.assign_folds(d2, 5, 42).collect()
    for c in (0, 1):
        sizes = Counter(r.kfold for r in rows if r.cls == c).values()
        assert max(sizes) - min(sizes) <= 1
    assert len({r.workitem for r in rows}) == len(rows)


def test_every_sequence_validated_once_trained_k_minus_1(spark):
    fld = FO.assign_folds(labelled_sequences(spark, SF_SMALL), 5, 42)
    n = fld.count()
    assert FO.validation_rows(fld).count() == n
    assert FO.training_fanout(fld, 5).count() == 4 * n
