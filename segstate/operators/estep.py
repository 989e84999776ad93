"""E-step over all models at once (R9 + R10).

Rows are the fold table (cls, kfold, obs), without parameters; a sequence of
fold g trains the models of its class with fold != g, and the (sequence, model)
pairs are formed inside the task. Whole sequences run through the vectorised
kernel, grouped by length so that no padding is needed; sequences in blocks
through ``blockpass``. A task emits one small long-form block (fold, cls, param,
i, j, value) per model it saw, never one row per sequence; the final sum is a
two-phase hash aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.operators import blockpass, kernel
from segstate.operators.blockpass import CELL_BUDGET, add_by_model, check_symbols
from segstate.operators.scoring import model_params
from segstate.spec import HsmmSpec

STATS_SCHEMA = "fold int, cls int, param string, i int, j int, value double"
_ARROW = pa.schema([("fold", pa.int32()), ("cls", pa.int32()), ("param", pa.string()), ("i", pa.int32()), ("j", pa.int32()),
                    ("value", pa.float64())])
PARAMS = ("loglik", "n_seq", "n_undefined", "pi", "a", "b", "p")


def _emit(sums: dict, spec: HsmmSpec) -> pa.RecordBatch:
    """Long form of the sums of each model: scalars, vectors and matrices."""
    parts = []
    for name in (x for x in PARAMS if x in next(iter(sums.values()))):
        cells = np.stack([np.asarray(s[name], dtype=float) for s in sums.values()])
        shape = (cells.shape + (1, 1))[1:3]  # scalars and vectors have one column
        model, i, j = (x.ravel() for x in np.indices((len(sums), *shape)))
        parts.append((name, model, i, j, cells.ravel()))
    keys = np.array(list(sums), dtype=np.int32).reshape(-1, 2)
    model = np.concatenate([p[1] for p in parts])
    names = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[model, 0]), pa.array(keys[model, 1]), pa.array(names.tolist(), pa.string()),
         *(pa.array(np.concatenate([p[x] for p in parts]).astype(np.int32)) for x in (2, 3)),
         pa.array(np.concatenate([p[4] for p in parts]))], schema=_ARROW)


def partial_sums_by_fold(spec: HsmmSpec, params: dict, k: int, skip_undefined: bool = False):
    """Sums over whole sequences (cls, kfold, obs) of the models in ``params``.
    With ``skip_undefined`` a sequence whose estimates hold a NaN (0/0, Q10) is
    left out and counted in ``n_undefined``; by default it poisons the sums like
    the reference."""
    m, kk, d = spec.m, spec.k, spec.d
    keys = sorted(params)
    stack = [np.stack([params[key][x] for key in keys]) for x in range(4)]  # pi, a, b, p
    classes = sorted({c for _, c in keys})
    col_of = {c: i for i, c in enumerate(classes)}
    index = np.full((k, len(classes)), -1, dtype=np.int64)
    for n, (f, c) in enumerate(keys):
        index[f, col_of[c]] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {"loglik": np.zeros(len(keys)), "n_seq": np.zeros(len(keys)),
                "n_undefined": np.zeros(len(keys)), "pi": np.zeros((len(keys), m)),
                "a": np.zeros((len(keys), m, m)), "b": np.zeros((len(keys), m, kk)),
                "p": np.zeros((len(keys), m, d))}
        seen = np.zeros(len(keys), dtype=bool)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            clss = batch.column("cls").to_numpy(zero_copy_only=False)
            kfolds = batch.column("kfold").to_numpy(zero_copy_only=False)
            obs_col = batch.column("obs")
            lens = obs_col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            vals = obs_col.flatten().to_numpy(zero_copy_only=False)
            check_symbols(vals, kk)
            offs = np.concatenate([[0], np.cumsum(lens)])
            ccol = np.full(batch.num_rows, -1, dtype=np.int64)
            for c, i in col_of.items():
                ccol[clss == c] = i
            for t_len in np.unique(lens):
                if t_len == 0:
                    continue
                rows = np.flatnonzero((lens == t_len) & (ccol >= 0))
                # (sequence, model) pairs: every fold but the row's own
                rep = np.repeat(rows, k)
                fold = np.tile(np.arange(k), len(rows))
                model = index[fold, ccol[rep]]
                ok = (fold != kfolds[rep]) & (model >= 0)
                rep, model = rep[ok], model[ok]
                order = np.argsort(model, kind="stable")
                rep, model = rep[order], model[order]
                step = max(1, CELL_BUDGET // int(t_len * m * max(d, m, kk)))
                for lo in range(0, len(rep), step):
                    r, mdl = rep[lo: lo + step], model[lo: lo + step]
                    obs = vals[offs[r][:, None] + np.arange(t_len)[None, :]].astype(np.int64)
                    sc, npi, na, nb, np_ = kernel.e_step(obs, kk, *(x[mdl] for x in stack))
                    good = np.ones(len(r), dtype=bool)
                    if skip_undefined:
                        good = ~(np.isnan(npi).any(axis=1) | np.isnan(na).any(axis=(1, 2))
                                 | np.isnan(nb).any(axis=(1, 2)) | np.isnan(np_).any(axis=(1, 2)))
                    seen[mdl] = True
                    add_by_model(sums["n_undefined"], mdl, (~good | ~np.isfinite(sc)).astype(float))
                    g = mdl[good]
                    add_by_model(sums["n_seq"], g, np.ones(len(g)))
                    for name, v in (("loglik", sc), ("pi", npi), ("a", na), ("b", nb), ("p", np_)):
                        add_by_model(sums[name], g, v[good])
        acc = {keys[n]: {name: v[n] for name, v in sums.items()} for n in np.flatnonzero(seen)}
        if acc:
            yield _emit(acc, spec)

    return run


def partial_sums(folded: DataFrame, params: dict, spec: HsmmSpec, k: int, skip_undefined: bool = False,
                 parts: bool | None = None) -> DataFrame:
    """``STATS_SCHEMA`` rows of every task. ``parts`` tells whether some sequences
    stand in several blocks, for callers that know."""
    rows = blockpass.whole_rows(folded.where(F.col("obs").isNotNull()))
    partial = rows.select("cls", "kfold", "obs").mapInArrow(partial_sums_by_fold(spec, params, k, skip_undefined), STATS_SCHEMA)
    if blockpass.has_parts(folded) if parts is None else parts:
        blocks = blockpass.consume_blocks(blockpass.part_rows(folded), params, spec, blockpass.trained_by(params),
                                          lambda: blockpass.EStep(spec, skip_undefined, _emit), STATS_SCHEMA)
        partial = partial.unionByName(blocks)
    return partial


def e_step_stats_folded(folded: DataFrame, models: DataFrame | dict, spec: HsmmSpec, k: int,
                        skip_undefined: bool = False, parts: bool | None = None) -> DataFrame:
    """E-step sums of every model over the fold table (cls, kfold, obs and, for
    sequences in blocks, rid, t0, whole). ``models`` is a table or what
    ``model_params`` gives. Models beyond the limit for tables that travel with
    the tasks are joined to the symbols (``wide``)."""
    params = models if isinstance(models, dict) else model_params(models, spec)
    if params is None:
        from segstate.operators.wide import wide_e_step
        return wide_e_step(folded, models, spec, skip_undefined)
    return (partial_sums(folded, params, spec, k, skip_undefined, parts)
            .groupBy("fold", "cls", "param", "i", "j").agg(F.sum("value").alias("value")))
