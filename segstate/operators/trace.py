"""Long-form output of the per-sequence recursions.

For inspection and per-operator checks: every held-out sequence emits the
requested quantity under both models of its fold, as rows (workitem, cls, param,
t, i, j, value) where ``cls`` is the class of the model. The recursions are those
of the E-step, and only what the quantity needs is computed. A kernel call takes
as many sequences of one length as fit in the cell budget; sequences in blocks
come block by block with the carried states of ``blockpass``. So a task holds at
most the budget, whatever the number and the length of the sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.operators import blockpass, kernel
from segstate.operators.scoring import model_params
from segstate.spec import HsmmSpec

TRACE_SCHEMA = "workitem string, cls int, param string, t int, i int, j int, value double"
_ARROW = pa.schema([("workitem", pa.string()), ("cls", pa.int32()), ("param", pa.string()), ("t", pa.int32()), ("i", pa.int32()),
                    ("j", pa.int32()), ("value", pa.float64())])
EMIT_CELLS = 250_000  # rows of one emitted batch and cells of one kernel call

# operator -> names of its arrays
WHAT = {
    "segment_likelihood": ["u"],
    "forward_alpha": ["alpha", "alpha_prime", "scale"],
    "backward_beta": ["beta", "beta_prime"],
    "duration_posterior": ["n"],
    "transition_posterior": ["xi"],
    "state_occupancy": ["gamma"],
    "estimate_transition": ["new_a"],
    "estimate_emission": ["new_b"],
    "estimate_duration": ["new_p"],
    "estimate_initial": ["new_pi"],
}
# how each array maps to (t, i, j): the axes after that of the sequence
_AXES = {
    "u": "tij", "alpha": "ti", "alpha_prime": "ti", "scale": "t", "beta": "ti", "beta_prime": "ti",
    "n": "tij", "xi": "tij", "gamma": "ti", "new_a": "ij", "new_b": "ij", "new_p": "ij", "new_pi": "i",
}


class _Recursions:
    """Arrays of a batch of whole sequences, each computed when it is read."""

    def __init__(self, obs, k, pi, a, b, p):
        self.obs, self.k, self.pi, self.a, self.p = obs, k, pi, a, p
        self.made = {"u": kernel.segment_likelihood(obs, b, p.shape[2])[1]}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made.update(self.compute(name))
        return self.made[name]

    def compute(self, name: str) -> dict:
        if name in ("alpha", "alpha_prime", "scale"):
            return dict(zip(("alpha", "alpha_prime", "scale"), kernel.forward(self.pi, self.a, self.p, self["u"]), strict=False))
        if name in ("beta", "beta_prime"):
            return dict(zip(("beta", "beta_prime"), kernel.backward(self.a, self.p, self["u"]), strict=True))
        if name == "n":
            return {name: kernel.duration_posterior(self["alpha_prime"], self.p, self["u"], self["beta"])}
        if name == "xi":
            return {name: kernel.transition_posterior(self["alpha"], self.a, self["beta_prime"])}
        if name == "gamma":
            return {name: kernel.occupancy(self.pi, self["alpha"], self["alpha_prime"], self["beta"], self["beta_prime"])}
        if name == "new_a":
            return {name: kernel.new_transition(self["xi"].sum(axis=1))}
        if name == "new_p":
            return {name: kernel.new_duration(self["n"].sum(axis=1))}
        if name == "new_pi":
            return {name: kernel.new_initial(self["gamma"][:, 0])}
        return {name: kernel.new_emission(kernel.symbol_sums(self.obs, self["gamma"], self.k), self["gamma"].sum(axis=1))}


def _emit(workitems: list, classes: list[int], name: str, values: np.ndarray,
          t0: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of an array whose first axis runs over (workitem, class) pairs, ``t0``
    the place of the first position of each."""
    ids, models = pa.array(workitems, pa.string()), np.asarray(classes, dtype=np.int32)
    cells = int(np.prod(values.shape[1:]))
    flat = values.reshape(-1)
    for lo in range(0, len(flat), EMIT_CELLS):
        at = np.arange(lo, min(lo + EMIT_CELLS, len(flat)))
        row, rest = at // cells, at % cells
        places = dict(zip(_AXES[name], np.unravel_index(rest, values.shape[1:]), strict=True))
        zero = np.zeros(len(at), dtype=np.int32)
        t, i, j = (pa.array(places.get(x, zero).astype(np.int32) + (t0[row].astype(np.int32) if t0 is not None and x == "t" and x in places else 0), pa.int32()) for x in "tij")
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(models[row]),
                                          pa.array([name]).take(pa.array(np.zeros(len(at), dtype=np.int64))), t, i, j, pa.array(flat[at])],
                                         schema=_ARROW)


def _whole(params: dict, spec: HsmmSpec, names: list[str]):
    stacks = {key: params[key] for key in sorted(params)}
    index = {key: n for n, key in enumerate(stacks)}
    stack = [np.stack([v[x] for v in stacks.values()]) for x in range(4)]
    choice = blockpass.held_out(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, folds = batch.column("workitem").to_pylist(), batch.column("fold").to_pylist()
            obs_col = batch.column("obs")
            lens = obs_col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            vals = obs_col.flatten().to_numpy(zero_copy_only=False)
            blockpass.check_symbols(vals, spec.k)
            offs = np.append(0, np.cumsum(lens))
            for t_len in np.unique(lens[lens > 0]):
                pairs = [(r, key) for r in np.flatnonzero(lens == t_len).tolist() for key in choice(0, folds[r])]
                step = max(1, EMIT_CELLS // int(t_len * spec.m * max(spec.d, spec.m)))
                for lo in range(0, len(pairs), step):
                    part = pairs[lo:lo + step]
                    rows, at = np.array([r for r, _ in part]), [index[key] for _, key in part]
                    obs = vals[offs[rows][:, None] + np.arange(t_len)].astype(np.int64)
                    made = _Recursions(obs, spec.k, *(x[at] for x in stack))
                    for name in names:
                        yield from _emit([ids[r] for r in rows], [key[1] for _, key in part], name, made[name])
    return run


class _Parts:
    """The same for sequences in blocks."""

    def __init__(self, spec: HsmmSpec, names: list[str]):
        self.spec, self.names, self.open = spec, names, blockpass.Open()

    def block(self, x: blockpass.Block):
        for name in self.names:
            values = self.values(name, x)
            if values is not None:
                ids = x.chunk.batch.column("workitem").take(pa.array(x.rows)).to_pylist()
                yield from _emit(ids, [x.models.keys[i][1] for i in x.model], name, values, x.t0)

    def values(self, name: str, x: blockpass.Block) -> np.ndarray | None:
        end = x.obs.shape[1]
        simple = {"u": x.u, "alpha": x.alpha, "scale": x.scale, "beta": x.beta, "gamma": x.gamma}
        if name in simple:
            return simple[name]
        if name in ("alpha_prime", "beta_prime"):
            # the place after the last one is that of the next block
            found = x.ap if name == "alpha_prime" else x.bp
            return found if x.last else found[:, :end]
        if name == "n":
            return x.durations()
        if name == "xi":
            return kernel.transition_posterior(x.alpha, x.stack[1], x.bp)
        if name == "new_pi":
            return kernel.new_initial(x.gamma[:, 0]) if x.first else None
        if name == "new_a":
            total = self.open.add(x, name, kernel.transition_posterior(x.alpha, x.stack[1], x.bp).sum(axis=1))
            return None if total is None else kernel.new_transition(total)
        if name == "new_p":
            total = self.open.add(x, name, x.durations().sum(axis=1))
            return None if total is None else kernel.new_duration(total)
        by_symbol = self.open.add(x, name, kernel.symbol_sums(x.obs, x.gamma, self.spec.k))
        every = self.open.add(x, "sum_g", x.gamma.sum(axis=1))
        return None if by_symbol is None else kernel.new_emission(by_symbol, every)

    def close(self):
        return ()


def kernel_long_form(rows: DataFrame, models: DataFrame | dict, spec: HsmmSpec, what: str) -> DataFrame:
    """``rows`` (workitem, fold, obs and, for sequences in blocks, cls, rid, t0,
    whole) under the models of their fold."""
    params = models if isinstance(models, dict) else model_params(models, spec)
    if params is None:
        raise ValueError("the long form needs models that travel with the tasks")
    names = WHAT[what]
    whole = blockpass.whole_rows(rows.where(F.col("obs").isNotNull()))
    out = whole.select(F.col("workitem").cast("string"), "fold", "obs").mapInArrow(_whole(params, spec, names), TRACE_SCHEMA)
    if blockpass.has_parts(rows):
        parts = blockpass.part_rows(rows.withColumn("kfold", F.col("fold")))
        out = out.unionByName(blockpass.consume_blocks(parts, params, spec, blockpass.held_out(params),
                                                       lambda: _Parts(spec, names), TRACE_SCHEMA))
    return out.withColumn("value", F.round("value", 6))
