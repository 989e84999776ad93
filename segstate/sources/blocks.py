"""Sequences as blocks of symbols (S1b), so that no entity is one array.

Events are put in order by range partitioning on (entity, ts, tie): an entity
that holds a large share of all events spreads over many partitions. Inside a
partition one streaming pass cuts each run of an entity into blocks of at most
``block`` symbols. A run that is cut, or that touches an edge of its partition,
may belong to a sequence of several blocks; only their slim keys (at most two per
partition and events / block) go through a window that gives each block its place
``t0`` and the sequence its label and id.

A sequence table has the columns (rid, workitem, cls, t0, whole, obs): ``rid`` is
the row id of the sequence, the same in all its blocks; ``whole`` tells rows that
are a whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstate.session import materialize

BLOCK = 4096  # symbols
COLUMNS = ["rid", "workitem", "cls", "t0", "whole", "obs"]


class _Open:
    """The run that the last batch ended in."""

    def __init__(self, key, number: int):
        self.key, self.number = key, number
        self.pending: list[np.ndarray] = []
        self.n = self.done = 0
        self.lab = False

    def add(self, symbols: np.ndarray, lab: bool) -> None:
        self.pending.append(symbols)
        self.n += len(symbols)
        self.lab |= lab

    def take(self, n: int) -> np.ndarray:
        joined = np.concatenate(self.pending) if self.pending else np.zeros(0, np.int32)
        self.pending, self.n, self.done = [joined[n:]], len(joined) - n, self.done + n
        return joined[:n]


def _cut(block: int, key_type: pa.DataType):
    """Runs of sorted rows (workitem, sym, lab) as blocks."""
    schema = pa.schema([("workitem", key_type), ("rid", pa.int64()), ("t", pa.int64()), ("whole", pa.bool_()),
                        ("lab", pa.bool_()), ("obs", pa.list_(pa.int32()))])

    def one(run: _Open, base: int, n: int, whole: bool) -> pa.RecordBatch:
        t = run.done
        return pa.RecordBatch.from_arrays(
            [pa.array([run.key], key_type), pa.array([base + run.number]), pa.array([t]), pa.array([whole]), pa.array([run.lab]),
             pa.array([run.take(n)], pa.list_(pa.int32()))], schema=schema)

    def inner(keys: pa.Array, first: int, length: np.ndarray, lab: np.ndarray, symbols: np.ndarray) -> pa.RecordBatch:
        """Runs that begin and end inside a batch."""
        pieces = np.maximum(1, -(-length // block))
        at = np.repeat(np.arange(len(length)), pieces)
        t = (np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * block
        offsets = np.append(0, np.cumsum(np.minimum(length[at] - t, block))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(at)), pa.array(first + at), pa.array(t), pa.array(pieces[at] == 1), pa.array(lab[at]),
             pa.ListArray.from_arrays(offsets, pa.array(symbols))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, opened = TaskContext.get().partitionId() << 33, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            key = batch.column("workitem")
            lab = batch.column("lab").to_numpy(zero_copy_only=False).astype(bool)
            sym = batch.column("sym").to_numpy(zero_copy_only=False).astype(np.int32)
            edge = np.ones(n, dtype=bool)
            if n > 1:
                same = pc.fill_null(pc.equal(key[1:], key[:-1]), False).to_numpy(zero_copy_only=False)
                null = pc.is_null(key).to_numpy(zero_copy_only=False)
                edge[1:] = ~(same | (null[1:] & null[:-1]))
            starts = np.flatnonzero(edge)
            ends = np.append(starts[1:], n)
            held = np.append(0, np.cumsum(~lab))
            label, symbols = np.maximum.reduceat(lab, starts), sym[~lab]

            def of(i):
                return symbols[held[starts[i]]:held[ends[i]]]
            number = 0 if opened is None else opened.number + 1
            begin = 0
            if opened is not None and key[0].as_py() == opened.key:
                opened.add(of(0), bool(label[0]))
                begin, number = 1, opened.number + 1
            last = len(starts) - 1
            if begin <= last:
                if opened is not None:
                    yield from _flush(opened, base, block, one)
                    yield one(opened, base, opened.n, opened.done == 0 and opened.number > 0)
                if begin < last:
                    # the very first run of a partition may go on from the one before
                    if number == 0:
                        opened = _Open(key[0].as_py(), 0)
                        opened.add(of(0), bool(label[0]))
                        yield from _flush(opened, base, block, one)
                        yield one(opened, base, opened.n, False)
                        begin, number = begin + 1, 1
                if begin < last:
                    yield inner(key.take(pa.array(starts[begin:last])), base + number, held[ends[begin:last]] - held[starts[begin:last]],
                                label[begin:last], symbols[held[starts[begin]]:held[ends[last - 1]]])
                    number += last - begin
                opened = _Open(key[n - 1].as_py(), number)
                opened.add(of(last), bool(label[last]))
            yield from _flush(opened, base, block, one)
        if opened is not None:
            yield one(opened, base, opened.n, False)
    return run


def _flush(run: _Open, base: int, block: int, one) -> Iterator[pa.RecordBatch]:
    """Full blocks of a run that goes on; some symbol always stays."""
    while run.n > block:
        yield one(run, base, block, False)


def event_blocks(events: DataFrame, workitem: Column, symbol: Column, label: Column | None = None, ts: str = "ts",
                 tie: str = "event_id", block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """The stored sequence table of an event table. Events with ``label``
    true set class 1 and give no symbol; sequences without symbols are dropped.
    Without ``label`` all sequences have class 1."""
    rows = events.select(workitem.alias("workitem"), F.col(ts).alias("ts"), F.col(tie).alias("tie"),
                         F.when(F.lit(False) if label is None else label, F.lit(-1)).otherwise(symbol).cast("int").alias("sym"),
                         F.coalesce(F.lit(False) if label is None else label, F.lit(False)).alias("lab"))
    order = ["workitem", "ts", "tie"]
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    kind = rows.schema["workitem"].dataType.simpleString()
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    cut = materialize(ranged.select("workitem", "sym", "lab").mapInArrow(
        _cut(block, arrow), f"workitem {kind}, rid long, t long, whole boolean, lab boolean, obs array<int>"), "cut")
    cls = F.lit(1) if label is None else F.col("lab").cast("int")
    whole = cut.where("whole").where(F.size("obs") > 0).select("rid", "workitem", cls.alias("cls"), F.lit(0).cast("long").alias("t0"), "whole", "obs")
    # slim keys of the other blocks: their place, and label and id of their sequence
    keys = cut.where("not whole").select("workitem", "rid", "t", F.size("obs").cast("long").alias("n"), "lab")
    every = Window.partitionBy("workitem")
    before = every.orderBy("rid", "t").rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.select("rid", "t", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("t0"), F.sum("n").over(every).alias("total"),
                         F.max("lab").over(every).alias("any"), F.min("rid").over(every).alias("id")).where("n > 0")
    placed = placed.select("rid", "t", "t0", "any", "id", (F.col("n") == F.col("total")).alias("alone"))
    cls = F.lit(1) if label is None else F.col("any").cast("int")
    parts = (cut.where("not whole").drop("whole", "lab").join(placed, ["rid", "t"])
             .select(F.col("id").alias("rid"), "workitem", cls.alias("cls"), "t0", F.col("alone").alias("whole"), "obs"))
    return whole.unionByName(parts)


def array_blocks(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The sequence table of rows (workitem, cls, obs) that arrive as arrays; a
    null or empty array stays one empty row."""
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("obs") / F.lit(block)) - 1, F.lit(0)).cast("int"))
    long = F.coalesce(F.size("obs") > block, F.lit(False))
    rows = seqs.select(F.monotonically_increasing_id().alias("rid"), "workitem", F.col("cls").cast("int").alias("cls"), "obs")
    return (rows.withColumn("piece", F.explode(F.when(long, pieces).otherwise(F.array(F.lit(0)))))
            .select("rid", "workitem", "cls", (F.col("piece") * F.lit(block)).cast("long").alias("t0"), (~long).alias("whole"),
                    F.when(long, F.slice("obs", F.col("piece") * F.lit(block) + 1, F.lit(block))).otherwise(F.col("obs")).alias("obs")))


def symbols(seqs: DataFrame) -> DataFrame:
    """Long form of a sequence table: (workitem, cls, t, sym)."""
    return (seqs.select("workitem", "cls", "t0", F.posexplode("obs").alias("pos", "sym"))
            .select("workitem", "cls", (F.col("t0") + F.col("pos")).alias("t"), "sym"))


def arrays(seqs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Whole arrays (workitem, cls, obs), the form of a text line. Blocks are put
    together per sequence, so a line is as long as its sequence."""
    keep = keep or []
    parts = seqs.where("not whole").groupBy("rid", "workitem", "cls", *keep).agg(
        F.array_sort(F.collect_list(F.struct("t0", "obs"))).alias("x"))
    parts = parts.select("workitem", "cls", *keep, F.flatten(F.transform("x", lambda b: b["obs"])).alias("obs"))
    return seqs.where("whole").select("workitem", "cls", *keep, "obs").unionByName(parts)
