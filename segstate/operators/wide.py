"""Models whose emission matrix is too large to travel with the tasks.

The emission matrix B has one column per symbol and grows with the alphabet; Pi,
A and P do not. So B stays a table: ``cells`` (sym, e) holds for each symbol the
emissions of all models side by side, and the distinct symbols of each block of a
sequence are joined to it by symbol (a shuffle join that the runtime splits when a
symbol is skewed). A block then carries the emissions that it needs, and the
recursions run as in ``blockpass``. Estimates of B leave a task as cells of the
symbols that occurred, summed per cell by the aggregate, never as a matrix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstate.operators import blockpass
from segstate.operators.estep import STATS_SCHEMA, _emit
from segstate.operators.scoring import SCORES, _parts
from segstate.spec import HsmmSpec

SMALL = ["fold", "cls", "pi", "a", "p"]


def emission_cells(models: DataFrame) -> DataFrame:
    """(fold, cls, sym, e) of model rows with b as a matrix."""
    column = F.transform(F.sequence(F.lit(0), F.size(F.col("b")[0]) - 1), lambda v: F.transform("b", lambda row: row[v]))
    return models.select("fold", "cls", F.posexplode(column).alias("sym", "e"))


def small_params(models: DataFrame) -> dict:
    """(fold, cls) -> (pi, a, None, p): a row per model, of a size that M and D
    fix and the alphabet does not change."""
    return {(r.fold, r.cls): (np.asarray(r.pi, float), np.asarray(r.a, float), None, np.asarray(r.p, float))
            for r in models.select(*SMALL).collect()}


def side_by_side(cells: DataFrame, keys: list[tuple[int, int]], m: int) -> DataFrame:
    """(sym, e): the emissions of the models ``keys`` of a symbol, in this order;
    a model without a cell emits it nowhere."""
    name = F.concat_ws(":", "fold", "cls")
    found = cells.groupBy("sym").agg(F.map_from_entries(F.collect_list(F.struct(name, "e"))).alias("by"))
    zero = F.array(*[F.lit(0.0)] * m)
    return found.select("sym", F.concat(*[F.coalesce(F.try_element_at("by", F.lit(f"{f}:{c}")), zero) for f, c in keys]).alias("e"))


def _standard(rows: DataFrame) -> DataFrame:
    if "whole" not in rows.columns:
        rows = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("t0", F.lit(0).cast("long")).withColumn("whole", F.lit(True))
    return rows.where(F.size("obs") > 0).select("cls", "rid", "kfold", F.col("workitem").cast("string").alias("workitem"), "t0", "whole", "obs")


def _neighbours(rows: DataFrame, keep: int) -> DataFrame:
    """Adds ``near``: the symbols outside a block that its recursions read, the
    ``keep`` ones before and after it and, for the first block, the last of the
    sequence. Only the edges of blocks go through the window."""
    parts = rows.where("not whole")
    head = F.slice("obs", 1, keep) if keep else F.array().cast("array<int>")
    tail = F.slice("obs", F.greatest(F.size("obs") - keep + 1, F.lit(1)), keep) if keep else F.array().cast("array<int>")
    slim = parts.select("cls", "rid", "t0", head.alias("head"), tail.alias("tail"), F.element_at("obs", -1).alias("end"))
    order = Window.partitionBy("cls", "rid").orderBy("t0")
    none = F.array().cast("array<int>")
    # a block may be shorter than ``keep``, so as many blocks are looked at
    before = [F.coalesce(F.lag("tail", i).over(order), none) for i in range(1, keep + 1)]
    after = [F.coalesce(F.lead("head", i).over(order), none) for i in range(1, keep + 1)]
    last = F.last("end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = slim.select("cls", "rid", "t0", F.concat(F.array(last), *before, *after).alias("near"))
    return (rows.where("whole").withColumn("near", F.array(F.element_at("obs", -1)))
            .unionByName(parts.join(near, ["cls", "rid", "t0"])))


def with_cells(rows: DataFrame, params: dict, cells: DataFrame, spec: HsmmSpec) -> DataFrame:
    """``PART`` rows (and ``whole``) with the emissions of the symbols that each
    block needs. A symbol outside [0, K) raises."""
    near = _neighbours(rows, spec.d - 1)
    known = F.array_sort(F.array_distinct(F.concat("obs", "near")))
    wrong = F.exists(known, lambda v: (v < 0) | (v >= spec.k))
    known = F.when(wrong, F.raise_error(F.concat(F.lit("symbol outside [0, "), F.lit(spec.k), F.lit(")")))).otherwise(known)
    near = near.withColumn("local", known).drop("near")
    symbols = near.select("cls", "rid", "t0", F.explode("local").alias("sym"))
    keys = sorted(params)
    nothing = F.array(*[F.lit(0.0)] * (spec.m * len(keys)))  # for a symbol that no model emits
    found = (symbols.join(side_by_side(cells, keys, spec.m), "sym", "left").withColumn("e", F.coalesce("e", nothing))
             .groupBy("cls", "rid", "t0").agg(F.array_sort(F.collect_list(F.struct("sym", "e"))).alias("x")))
    joined = near.join(found, ["cls", "rid", "t0"])
    return joined.select("cls", "rid", "kfold", "workitem", "t0", "whole", "obs", F.transform("x", lambda c: c["sym"]).alias("local"),
                         F.flatten(F.transform("x", lambda c: c["e"])).alias("cells"))


def _one_block(rows: DataFrame) -> DataFrame:
    """Whole sequences as ``BACKWARD`` rows: both edges are known."""
    none = F.array().cast("array<int>")
    return rows.where("whole").drop("whole").select(
        "*", none.alias("hist"), F.lit(None).cast("array<double>").alias("heads"), none.alias("next"),
        F.lit(None).cast("array<double>").alias("tails"), F.element_at("obs", -1).alias("end"))


def wide_sums(rows: DataFrame, params: dict, cells: DataFrame, spec: HsmmSpec, skip_undefined: bool = False) -> DataFrame:
    """E-step sums (``STATS_SCHEMA``); cells of B that are zero are absent."""
    choice = blockpass.trained_by(params)
    ready = with_cells(_standard(rows.where(F.col("obs").isNotNull())), params, cells, spec)

    def consumer():
        return blockpass.EStep(spec, skip_undefined, _emit, dense=False)
    blocks = blockpass._blocks(params, spec, choice)

    def run(batches):
        used = consumer()
        for block in blocks(batches):
            yield from used.block(block)
        yield from used.close()
    sums = _one_block(ready).mapInArrow(run, STATS_SCHEMA)
    if "whole" in rows.columns:
        parts = ready.where("not whole").drop("whole")
        sums = sums.unionByName(blockpass.consume_blocks(parts, params, spec, choice, consumer, STATS_SCHEMA))
    return sums.groupBy("fold", "cls", "param", "i", "j").agg(F.sum("value").alias("value"))


def wide_e_step(rows: DataFrame, models: DataFrame, spec: HsmmSpec, skip_undefined: bool = False) -> DataFrame:
    return wide_sums(rows, small_params(models), emission_cells(models), spec, skip_undefined)


def wide_scores(valid: DataFrame, models: DataFrame, spec: HsmmSpec, lengths: list[int | None]) -> DataFrame:
    """Scores under both models of the fold of each row, as ``prefix_scores``."""
    params = small_params(models)
    ready = with_cells(_standard(valid.withColumn("kfold", F.col("fold"))), params, emission_cells(models), spec)
    run = _parts(params, spec, lengths)
    found = ready.where("whole").drop("whole").mapInArrow(run, SCORES)
    if "whole" in valid.columns:
        found = found.unionByName(blockpass.sorted_parts(ready.where("not whole").drop("whole")).mapInArrow(run, SCORES))
    return found


def wide_m_step(sums: DataFrame, spec: HsmmSpec, keys: list[tuple[int, int]], smoothing: float = 0.0) -> DataFrame:
    """(fold, cls, sym, e): the emission cells after an M-step, rows of B divided
    by the sum of their absolute values. With ``smoothing`` no cell is absent."""
    b = sums.where("param = 'b'").select("fold", "cls", "i", F.col("j").cast("int").alias("sym"), "value")
    if smoothing:
        each = [F.struct(*[F.lit(v).cast("int").alias(n) for n, v in (("fold", f), ("cls", c), ("i", i))])
                for f, c in keys for i in range(spec.m)]
        grid = sums.sparkSession.range(spec.k).select(F.col("id").cast("int").alias("sym"), F.explode(F.array(*each)).alias("x"))
        b = (grid.select("x.*", "sym").join(b, ["fold", "cls", "i", "sym"], "left")
             .withColumn("value", F.coalesce("value", F.lit(0.0)) + smoothing))
    norms = b.groupBy("fold", "cls", "i").agg(F.sum(F.abs("value")).alias("norm"))
    scaled = b.join(F.broadcast(norms), ["fold", "cls", "i"]).withColumn(  # one row per model and state
        "value", F.when(F.col("norm") == 0, F.col("value")).otherwise(F.col("value") / F.col("norm")))
    return scaled.groupBy("fold", "cls", "sym").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))),
                                                                lambda x: x["value"]).alias("e"))


def model_rows(small: DataFrame, cells: DataFrame, spec: HsmmSpec) -> DataFrame:
    """``small`` with ``b``, the matrix of the cells, absent ones zero."""
    zero = F.array(*[F.lit(0.0)] * spec.m)
    by = cells.groupBy("fold", "cls").agg(F.map_from_entries(F.collect_list(F.struct("sym", "e"))).alias("by"))
    columns = F.transform(F.sequence(F.lit(0), F.lit(spec.k - 1)), lambda v: F.coalesce(F.try_element_at("by", v), zero))

    def row(i: int) -> Column:
        return F.transform("columns", lambda c: c[i])
    return (small.join(by, ["fold", "cls"]).withColumn("columns", columns)
            .withColumn("b", F.array(*[row(i) for i in range(spec.m)])).drop("by", "columns"))
