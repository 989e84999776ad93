"""Sequences in blocks give the results of whole arrays."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstate.operators import blockpass
from segstate.operators import folds as FO
from segstate.operators.estep import e_step_stats_folded
from segstate.operators.evaluate import score_both
from segstate.operators.trace import WHAT, kernel_long_form
from segstate.plans import catalog as C
from segstate.plans import em
from segstate.session import materialize, new_work_dir
from segstate.sources import blocks as BL
from segstate.sources import events as EV
from segstate.spec import HsmmSpec
from tests.conftest import SF_SMALL

SPEC = HsmmSpec(m=3, k=5, d=4)


def _events(spark):
    """A hot entity, short ones, one of labels only, nulls as an entity."""
    rng = random.Random(3)
    sizes = {"hot": 900, "a": 1, "b": 7, "c": 64, None: 5, "labels": 3} | {f"e{i}": rng.randrange(1, 20) for i in range(60)}
    rows, n = [], 0
    for key, size in sizes.items():
        for _ in range(size):
            n += 1
            lab = key == "labels" or rng.random() < 0.05
            rows.append((key, rng.randrange(50), n, "L" if lab else rng.choice("pqrs")))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "ent string, ts int, event_id int, kind string").repartition(6)


def _table(df, block, partitions=5):
    code = F.expr("instr('pqrs', kind) - 1")
    return BL.event_blocks(df, F.col("ent"), code, F.col("kind") == "L", block=block, partitions=partitions)


@pytest.mark.parametrize("block", [1, 5, 64, 4096])
def test_event_blocks(spark, block):
    rows, df = _events(spark)
    want, labels = {}, {}
    for key, _, _, kind in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        labels[key] = labels.get(key, 0) | (kind == "L")
        if kind != "L":
            want.setdefault(key, []).append("pqrs".index(kind))
    got = _table(df, block).collect()
    assert len({r.rid for r in got}) == len(want) and max(len(r.obs) for r in got) <= block
    by = {}
    for r in sorted(got, key=lambda r: r.t0):
        assert r.t0 == len(by.get(r.workitem, [])) and r.cls == labels[r.workitem]
        by.setdefault(r.workitem, []).extend(r.obs)
    assert by == want
    counts = {k: sum(r.workitem == k for r in got) for k in want}
    assert all(r.whole == (counts[r.workitem] == 1) for r in got)
    # the hot entity spreads over partitions and blocks
    assert counts["hot"] >= max(2, len(want["hot"]) // block)
    assert {r.workitem: list(r.obs) for r in BL.arrays(_table(df, block)).collect()} == want
    longs = BL.symbols(_table(df, block)).collect()
    assert sorted((str(r.workitem), r.t, r.sym) for r in longs) == sorted((str(k), t, s) for k, v in want.items() for t, s in enumerate(v))


def test_empty_events(spark):
    _, df = _events(spark)
    assert _table(df.where("ent = 'none'"), 5).collect() == []


@pytest.fixture(scope="module")
def tables(spark):
    """The same sequences as blocks of 5 symbols and as arrays; an id stands in
    both classes."""
    rng = random.Random(8)
    rows = [(f"w{i % 40}", i // 40, [rng.randrange(5) for _ in range(rng.choice([1, 2, 4, 5, 6, 11, 30]))]) for i in range(80)]
    seqs = spark.createDataFrame(rows, "workitem string, cls int, obs array<int>").repartition(3)
    arrays = materialize(FO.folded_sequences(materialize(BL.array_blocks(seqs)), 3, 1))
    pieces = F.sequence(F.lit(0), F.size("obs") - 1, F.lit(5))
    cut = (arrays.withColumn("p", F.explode(pieces)).withColumn("whole", F.size("obs") <= 5)
           .withColumn("t0", F.col("p").cast("long")).withColumn("obs", F.slice("obs", F.col("p") + 1, F.lit(5))).drop("p"))
    models = C.init_models(arrays.select(F.col("kfold").alias("fold"), "cls").distinct(), SPEC, 4)
    return arrays, materialize(cut), models


def _stats(df):
    return {(r.fold, r.cls, r.param, r.i, r.j): r.value for r in df.collect()}


def _same(a, b):
    assert set(a) == set(b)
    for k, v in a.items():
        assert b[k] == pytest.approx(v, rel=1e-9, abs=1e-9, nan_ok=True), k


def test_e_step(tables):
    arrays, cut, models = tables
    want = _stats(e_step_stats_folded(arrays, models, SPEC, 3))
    _same(want, _stats(e_step_stats_folded(cut, models, SPEC, 3)))


def test_e_step_in_chunks_of_models(tables, monkeypatch):
    arrays, cut, models = tables
    want = _stats(e_step_stats_folded(arrays, models, SPEC, 3))
    monkeypatch.setattr(blockpass, "CELL_BUDGET", 1)  # tasks read it in the closure of the module
    _same(want, _stats(e_step_stats_folded(cut, models, SPEC, 3)))


def test_chunks_in_process(tables, monkeypatch):
    """Chunks of one model, run in this process."""
    arrays, cut, models = tables
    from segstate.operators.estep import _emit
    from segstate.operators.scoring import model_params
    params = model_params(models, SPEC)
    rows = blockpass.with_edges(blockpass.part_rows(cut), params, SPEC, blockpass.trained_by(params))
    batches = rows.orderBy("cls", "rid", "t0").toArrow().to_batches()

    def sums():
        used = blockpass.EStep(SPEC, False, _emit)
        for x in blockpass._blocks(params, SPEC, blockpass.trained_by(params))(batches):
            list(used.block(x))
        return used.sums
    whole = sums()
    monkeypatch.setattr(blockpass, "CELL_BUDGET", 1)
    for key, s in sums().items():
        for name, v in s.items():
            np.testing.assert_allclose(v, whole[key][name], rtol=1e-12)


def test_scores_of_all_prefixes(tables):
    arrays, cut, models = tables
    lengths = [1, 3, 5, 6, 12, 400]

    def scores(df, t):
        return sorted(((r.workitem, r.cls, r.fold, r.t_prefix, round(r.score1, 9), round(r.score0, 9))
                       for r in score_both(FO.validation_rows(df), models, SPEC, 3, t).collect()))
    assert scores(cut, lengths) == scores(arrays, lengths)
    one = {t: sorted((r.workitem, r.cls, r.score1) for r in score_both(FO.validation_rows(arrays), models, SPEC, 3, t).collect()) for t in (3, None)}
    assert [x[:3] for x in one[3]] == sorted((r.workitem, r.cls, r.score1) for r in score_both(
        FO.validation_rows(arrays), models, SPEC, 3, [3, 5]).where("t_prefix = 3").collect())
    # an id of both classes keeps its own scores: 80 rows, not a join of them
    assert len(one[None]) == 80 and len({x[0] for x in one[None]}) == 40
    assert any(a[2] != b[2] for a, b in zip(one[None][::2], one[None][1::2], strict=True))


@pytest.mark.parametrize("what", sorted(WHAT))
def test_trace(tables, what):
    arrays, cut, models = tables

    def rows(df):
        return sorted(map(str, kernel_long_form(FO.validation_rows(df.where("cls = 1")), models, SPEC, what).collect()))
    got = rows(cut)
    assert got == rows(arrays) and {"cls=0", "cls=1"} <= {x.split(", ")[1] for x in got}


def test_training(spark, tables):
    arrays, cut, _ = tables
    a, b = (em.train_models(df, SPEC, 3, 4, new_work_dir(spark, "em"), 1e-4, 3).orderBy("fold", "cls").collect() for df in (arrays, cut))
    for x, y in zip(a, b, strict=True):
        assert x.loglik == pytest.approx(y.loglik, rel=1e-9)
        np.testing.assert_allclose(np.array(x.b), np.array(y.b), rtol=1e-7)


def test_symbol_out_of_range(tables):
    _, cut, models = tables
    bad = cut.withColumn("obs", F.when(F.col("t0") == 5, F.array(F.lit(7))).otherwise(F.col("obs")))
    with pytest.raises(Exception, match="outside"):
        score_both(FO.validation_rows(bad), models, SPEC, 3).collect()
    with pytest.raises(Exception, match="outside"):
        score_both(FO.validation_rows(bad.where("whole").withColumn("obs", F.array(F.lit(-1)))), models, SPEC, 3).collect()


def test_keys_cross_block_edges(spark):
    users = EV.user_sequences(spark, SF_SMALL, C.SHORT_BLOCK).collect()
    assert users and not any(r.whole for r in users)
