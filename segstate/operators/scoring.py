"""Scores of sequences under the two models of their fold, for every wanted
prefix length at once (V1-V3, V7).

One forward pass over a batch of equal-length sequences gives ln(scale) of every
position, and the score of the first T symbols is its running sum at T. So all
prefix lengths and both models come from one pass over the rows, which cross
Arrow once; models travel with the task (size checked). Sequences in blocks go
through the forward pass of ``blockpass`` with one running sum per model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.operators import blockpass, kernel
from segstate.operators.joins import broadcast_limit
from segstate.spec import HsmmSpec

SCORES = "workitem string, cls int, fold int, t_prefix int, score1 double, score0 double"


def model_params(models: DataFrame, spec: HsmmSpec) -> dict | None:
    """(fold, cls) -> numpy (pi, a, b, p), or None if the table is larger than
    the limit for tables that travel with the tasks. Dimensions give the size of
    a row, so only rows that fit are fetched."""
    most = broadcast_limit(models.sparkSession) // spec.model_row_bytes()
    rows = models.select("fold", "cls", "pi", "a", "b", "p").limit(most + 1).collect()
    if len(rows) > most:
        return None
    return {(r.fold, r.cls): tuple(np.asarray(x, dtype=float) for x in (r.pi, r.a, r.b, r.p)) for r in rows}


def running_scores(scale: np.ndarray, lengths: list[int | None]) -> np.ndarray:
    """(N, len(lengths)) scores of prefixes from scales (N, T); None is all."""
    with np.errstate(invalid="ignore", divide="ignore"):
        total = np.cumsum(np.log(scale), axis=1)
    t = scale.shape[1]
    return total[:, [(t if x is None else min(x, t)) - 1 for x in lengths]]


def _whole(params: dict, spec: HsmmSpec, lengths: list[int | None]):
    """Scores of whole sequences, vectorised over those of one length."""
    folds = sorted({f for f, _ in params})
    stack = {c: [np.stack([params[f, c][x] for f in folds]) for x in range(4)] for c in sorted({c for _, c in params})}
    schema = pa.schema([("workitem", pa.string()), ("cls", pa.int32()), ("fold", pa.int32()), ("t_prefix", pa.int32()),
                        ("score1", pa.float64()), ("score0", pa.float64())])
    longest = None if None in lengths else max(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            obs_col = batch.column("obs")
            lens = obs_col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            vals = obs_col.flatten().to_numpy(zero_copy_only=False)
            blockpass.check_symbols(vals, spec.k)
            offs = np.append(0, np.cumsum(lens))
            at = np.searchsorted(folds, batch.column("fold").to_numpy(zero_copy_only=False))
            used = lens if longest is None else np.minimum(lens, longest)
            for t_len in np.unique(used):
                rows = np.flatnonzero(used == t_len)
                step = max(1, blockpass.CELL_BUDGET // int(t_len * spec.m * max(spec.d, spec.m)))
                for lo in range(0, len(rows), step):
                    r = rows[lo:lo + step]
                    obs = vals[offs[r][:, None] + np.arange(t_len)].astype(np.int64)
                    got, k = [], len(lengths)
                    for c in (1, 0):
                        if c not in stack:
                            got.append(pa.nulls(len(r) * k, pa.float64()))
                            continue
                        pi, a, b, p = (x[at[r]] for x in stack[c])
                        u = kernel.segment_likelihood(obs, b, spec.d)[1]
                        got.append(pa.array(running_scores(kernel.forward(pi, a, p, u)[2], lengths).ravel()))
                    ids = pa.array(np.repeat(r, k))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("workitem").take(ids), batch.column("cls").take(ids), batch.column("fold").take(ids),
                         pa.array(lengths * len(r), pa.int32()), *got], schema=schema)
    return run


class _Running:
    """Running sums of sequences in blocks, one per pair and wanted length."""

    def __init__(self, lengths: list[int | None]):
        self.lengths, self.now, self.sums, self.row = lengths, None, None, None

    def scales(self, c: blockpass.Chunk, rows, pair, scale):
        if c is not self.now:
            self.now, self.sums = c, c.room(self.sums, len(self.lengths) + 1)  # the last one is of all symbols
        before = np.where(c.on[rows][:, None], c.handed(self.sums, rows, pair), 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            sums = before[:, -1:] + np.cumsum(np.log(scale), axis=1)
        after = np.repeat(sums[:, -1:], before.shape[1], axis=1)
        for i, t in enumerate(self.lengths):
            if t is not None:
                rest = t - c.t0[rows]
                at = np.clip(rest, 1, scale.shape[1]) - 1
                after[:, i] = np.where(rest > 0, sums[np.arange(len(at)), at], before[:, i])
        self.sums[c.carried + pair] = after

    def chunk(self, c: blockpass.Chunk, hist, held, heads):
        """The rows that end a sequence; whether the last one does is not known yet."""
        if not c.on[0]:
            yield from self.close()
        n = len(c.on) - 1
        ends = np.flatnonzero(~c.on[1:])
        if len(ends):
            yield self.out(c, ends)
        self.row = c, np.array([n]), self.sums

    def out(self, c: blockpass.Chunk, rows: np.ndarray, sums: np.ndarray | None = None) -> pa.RecordBatch:
        sums = self.sums if sums is None else sums
        of = np.full(len(c.on), -1)
        of[rows] = np.arange(len(rows))
        row = np.repeat(of, c.counts)
        pair = np.flatnonzero(row >= 0)
        cls = np.array([key[1] for key in c.models.keys])[c.model[pair]]
        n = len(self.lengths)
        scores = []
        for wanted in (1, 0):
            used = pair[cls == wanted]
            values, absent = np.zeros((len(rows), n)), np.ones((len(rows), n), dtype=bool)
            values[row[used]], absent[row[used]] = sums[c.carried + used, :n], False
            scores.append(pa.array(values.ravel(), mask=absent.ravel()))
        at = pa.array(np.repeat(rows, n))
        columns = [c.batch.column(x).take(at) for x in ("workitem", "cls", "kfold")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(self.lengths * len(rows), pa.int32()), *scores], schema=blockpass._schema(SCORES))

    def close(self):
        if self.row is not None:
            c, rows, sums = self.row
            self.row = None
            yield self.out(c, rows, sums)


def _parts(params: dict, spec: HsmmSpec, lengths: list[int | None]):
    return blockpass.forward_blocks(params, spec, blockpass.held_out(params), lambda: _Running(lengths))


def prefix_scores(valid: DataFrame, params: dict, spec: HsmmSpec, lengths: list[int | None]) -> DataFrame:
    """``SCORES`` of every row (workitem, cls, fold, obs) of ``valid``, once per
    length; ``valid`` may be a stream of whole sequences. With models of one class
    only, the score of the other is null."""
    lengths = list(dict.fromkeys(lengths))
    if any(t is not None and t < 1 for t in lengths):
        raise ValueError("a prefix has at least one symbol")
    folds, classes = {f for f, _ in params}, {c for _, c in params}
    if any((f, c) not in params for f in folds for c in classes):
        raise ValueError("every fold needs a model of every class")
    valid = valid.withColumn("workitem", F.col("workitem").cast("string")).where(F.col("fold").isin(sorted(folds)))
    found = blockpass.whole_rows(valid).select("workitem", "cls", "fold", "obs").mapInArrow(_whole(params, spec, lengths), SCORES)
    if "whole" not in valid.columns:
        return found
    parts = blockpass.part_rows(valid.withColumn("kfold", F.col("fold")))
    if None not in lengths:
        parts = parts.where(F.col("t0") < max(lengths))
    return found.unionByName(blockpass.sorted_parts(parts).mapInArrow(_parts(params, spec, lengths), SCORES))
