"""Recursions over sequences that are cut into blocks of symbols.

A sequence that is longer than a block stands in several rows (cls, rid, t0,
obs): ``t0`` is the place of the first symbol of the block. Per (cls, rid) the
blocks are dealt out by key and sorted by place, and three streaming passes run
the recursions of ``kernel`` block by block, for all models of a sequence at
once:

1. forward (t ascending) adds the state at the left edge of each block: the last
   D-1 symbols and the alpha' of the last D positions;
2. backward (t descending) adds the state at the right edge: the next D-1 symbols
   and their betas, and at the first block the last symbol of the sequence;
3. a last pass (t ascending) recomputes a block from its two edges and hands alpha,
   alpha', beta, beta' and gamma of the block to a consumer: the E-step sums
   them, the trace emits them.

What is shuffled are blocks with one state each, O(M D) numbers per model, never
the alphas and betas of single positions. A sequence of any length is exact; the
recursions are sequential (alpha' is normalised at every step), so one sequence
runs in one task, in time linear in its length.

Short sequences run together: of the rows that a task holds (``Chunk``), the first
blocks of all sequences are taken at once, then their second blocks and so on.
Blocks of one shape make one kernel call over (row, model) pairs, so that N T M D
stays under the cell budget; what a block hands to the next one stands in arrays
with a place per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.operators import kernel
from segstate.spec import HsmmSpec

CELL_BUDGET = 2_000_000  # N*T*M*D cells of a kernel call (16 MB per array)
KEY = ["cls", "rid"]
#: ``local`` and ``cells`` are the emissions of the symbols that a block needs,
#: for models whose emission matrix does not travel with the tasks
PART = "cls int, rid long, kfold int, workitem string, t0 long, obs array<int>, local array<int>, cells array<double>"
FORWARD = PART + ", hist array<int>, heads array<double>"
BACKWARD = FORWARD + ", next array<int>, tails array<double>, end int"

#: models of a sequence: (cls, kfold) -> keys of the parameters, in a fixed order
Choice = Callable[[int, int], list[tuple[int, int]]]


def trained_by(params: dict) -> Choice:
    """A sequence trains the models of its class of all folds but its own."""
    return lambda cls, kfold: sorted(k for k in params if k[1] == cls and k[0] != kfold)


def held_out(params: dict) -> Choice:
    """A sequence is scored under the two models of its fold, class 1 first."""
    return lambda cls, kfold: [(kfold, c) for c in (1, 0) if (kfold, c) in params]


def check_symbols(symbols: np.ndarray, k: int) -> None:
    """Q17: a symbol outside [0, k), or null, is an input error, never wrapped."""
    if symbols.dtype.kind not in "iu":  # Arrow turns integers with nulls into floats
        raise ValueError(f"null symbol: outside [0, {k})")
    if len(symbols) and (symbols.min() < 0 or symbols.max() >= k):
        bad = symbols[(symbols < 0) | (symbols >= k)][0]
        raise ValueError(f"symbol {bad} outside [0, {k})")


class Models:
    """The models of a task, stacked in the order of their keys. ``table`` (K,
    models, M) holds their emissions, unless each block brings its own."""

    def __init__(self, params: dict, choice: Choice):
        self.keys = sorted(params)
        self.place = {key: i for i, key in enumerate(self.keys)}
        self.choice, self.known, self.table = choice, {}, None
        if self.keys:
            self.pi, self.a, self.p = (np.stack([params[k][x] for k in self.keys]) for x in (0, 1, 3))
            if params[self.keys[0]][2] is not None:
                self.table = np.ascontiguousarray(np.stack([params[k][2] for k in self.keys]).transpose(2, 0, 1))

    def of(self, cls: int, kfold: int) -> np.ndarray:
        """Places of the models of a sequence."""
        if (cls, kfold) not in self.known:
            self.known[cls, kfold] = np.array([self.place[k] for k in self.choice(cls, kfold)], dtype=np.int64)
        return self.known[cls, kfold]

    def stack(self, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.pi[model], self.a[model], self.p[model]


class _Lists:
    """A list column as one array of values; a null list has size 0."""

    def __init__(self, column: pa.ListArray):
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)
        self.sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = column.flatten().to_numpy(zero_copy_only=False)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, rows: np.ndarray, size: int, offset: np.ndarray | int = 0) -> np.ndarray:
        return self.values[(self.starts[rows] + offset)[:, None] + np.arange(size)]


def _filled(found: np.ndarray, used: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.ListArray:
    """List column of the cells of ``found`` that ``used`` marks."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[used].ravel()), mask=None if valid is None else pa.array(~valid))


class Chunk:
    """Consecutive rows of a task. The (row, model) pairs stand row by row: those
    of row r begin at ``start[r]``. ``on`` marks rows that go on with the sequence
    of the row before, also of the last chunk; ``carried`` is the number of pairs
    that the first row takes over from there. ``number`` tells the first pair of
    the sequence of a row among all of the task, from ``since`` to ``upto``."""

    def __init__(self, batch: pa.RecordBatch, models: Models, picked: list[np.ndarray], on: np.ndarray, base: int, spec: HsmmSpec):
        self.batch, self.models, self.on, self.spec = batch, models, on, spec
        self.model = np.concatenate(picked)
        self.counts = np.array([len(x) for x in picked], dtype=np.int64)
        self.start = np.cumsum(self.counts) - self.counts
        self.carried = int(self.counts[0]) if on[0] else 0
        fresh = np.cumsum(np.where(on, 0, self.counts))
        self.number, self.upto = base + fresh - self.counts, base + int(fresh[-1])
        self.since = int(self.number[0])
        self.t0 = batch.column("t0").to_numpy(zero_copy_only=False)
        self.obs = _Lists(batch.column("obs"))
        check_symbols(self.obs.values, spec.k)
        self.table = models.table
        if self.table is None:
            local = _Lists(batch.column("local"))
            self.local = np.repeat(np.arange(len(on)), local.sizes) * spec.k + local.values
            self.table = _Lists(batch.column("cells")).values.reshape(len(self.local), len(models.keys), spec.m)

    def waves(self) -> Iterator[np.ndarray]:
        """Rows that need no other row of the same wave: the first ones of all
        sequences, their second ones and so on."""
        at = np.arange(len(self.on))
        begin = ~self.on
        begin[0] = True
        place = at - np.maximum.accumulate(np.where(begin, at, 0))
        order = np.argsort(place, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(place[order])) + 1)

    def pairs(self, rows: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of ``rows`` in parts of the cell budget: places in ``rows`` and in
        the chunk."""
        counts = self.counts[rows]
        at = np.repeat(np.arange(len(rows)), counts)
        pair = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + self.start[rows][at]
        step = max(1, CELL_BUDGET // (length * self.spec.m * max(self.spec.d, self.spec.m)))
        for lo in range(0, len(at), step):
            yield at[lo:lo + step], pair[lo:lo + step]

    def places(self, rows: np.ndarray, obs: np.ndarray) -> np.ndarray:
        """Places of the symbols (rows, T) in ``table``."""
        return obs if self.models.table is not None else np.searchsorted(self.local, rows[:, None] * self.spec.k + obs)

    def handed(self, after: np.ndarray, rows: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """What the row before left for these pairs; ``after`` begins with the
        carried ones."""
        return after[self.carried + pair - self.counts[rows]]

    def room(self, last: np.ndarray | None, *shape: int) -> np.ndarray:
        """An array of what the rows leave per pair, ``last`` that of the chunk before."""
        after = np.zeros((self.carried + len(self.model), *shape))
        if self.carried:
            after[:self.carried] = last[len(last) - self.carried:]
        return after


def _groups(rows: np.ndarray, *sizes: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Rows of the same sizes."""
    order = np.lexsort(sizes)
    sizes = np.stack([np.asarray(x)[order] for x in sizes])
    for part in np.split(np.arange(len(rows)), np.flatnonzero((np.diff(sizes) != 0).any(axis=0)) + 1):
        yield rows[order[part]], sizes[:, part[0]].tolist()


def _chunks(batches: Iterator[pa.RecordBatch], models: Models, spec: HsmmSpec) -> Iterator[Chunk]:
    """Rows that have models, in chunks whose sums per pair fit the cell budget."""
    most = max(1, CELL_BUDGET // (spec.m * max(spec.d, spec.m, 1 if models.table is None else spec.k)))
    key, base = None, 0
    for batch in batches:
        picked = [models.of(*x) for x in zip(batch.column("cls").to_pylist(), batch.column("kfold").to_pylist(), strict=True)]
        some = [i for i, x in enumerate(picked) if len(x)]
        if len(some) < len(picked):
            batch, picked = batch.take(pa.array(some, pa.int64())), [picked[i] for i in some]
        if not picked:
            continue
        keys = list(zip(batch.column("cls").to_pylist(), batch.column("rid").to_pylist(), strict=True))
        on = np.array([x == y for x, y in zip(keys, [key, *keys], strict=False)])
        key = keys[-1]
        ends = np.cumsum([len(x) for x in picked])
        lo = 0
        while lo < len(picked):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
            chunk = Chunk(batch.slice(lo, hi - lo), models, picked[lo:hi], on[lo:hi], base, spec)
            yield chunk
            lo, base = hi, chunk.upto


def _schema(spec: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(),
             "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in spec.split(", "))])


def _with(batch: pa.RecordBatch, spec: str, *columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with more columns, as rows of ``spec``."""
    schema = _schema(spec)
    arrays = [*(batch.column(name) for name in schema.names[:len(schema) - len(columns)]), *columns]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- the passes

def forward_blocks(params: dict, spec: HsmmSpec, choice: Choice, watch) -> Callable:
    """Runs the forward recursion over sorted blocks. ``watch()`` gives an object
    with ``scales(chunk, rows, pair, scale)`` for the pairs of a kernel call and,
    as iterators of Arrow batches, ``chunk(chunk, hist, held, heads)`` when the
    rows of a chunk are done and ``close()``. Of ``hist`` and ``heads`` of a row
    the first ``held`` symbols and one place more are filled."""
    keep, m = spec.d - 1, spec.m

    def run(batches):
        models, used = Models(params, choice), watch()
        last = None
        for c in _chunks(batches, models, spec):
            n = len(c.on)
            # what each row begins with, and what it leaves to the next one
            hist, held = np.zeros((n, keep), np.int64), np.zeros(n, np.int64)
            heads = np.zeros((len(c.model), keep + 1, m))
            left, left_held = np.zeros((n + 1, keep), np.int64), np.zeros(n + 1, np.int64)
            if c.carried:
                left[0], left_held[0] = last[0][-1], last[1][-1]
            left_heads = c.room(None if last is None else last[2], keep + 1, m)
            for wave in c.waves():
                held[wave] = np.where(c.on[wave], left_held[wave], 0)
                hist[wave] = left[wave]
                for rows, (t_len, h, on) in _groups(wave, c.obs.sizes[wave], held[wave], c.on[wave]):
                    joined = np.concatenate([hist[rows, :h], c.obs.take(rows, t_len)], axis=1)
                    look, size = c.places(rows, joined), min(keep, h + t_len)
                    left[rows + 1, :size], left_held[rows + 1] = joined[:, h + t_len - size:], size
                    for at, pair in c.pairs(rows, h + t_len):
                        model, row = c.model[pair], rows[at]
                        pi, a, p = models.stack(model)
                        before = c.handed(left_heads, row, pair)[:, :h + 1] if on else kernel.l1(pi)[:, None]
                        u = kernel.segments(c.table[look[at], model[:, None]], spec.d)
                        _, ap, scale, _ = kernel.forward(pi, a, p, u, before)
                        heads[pair, :h + 1] = before
                        left_heads[c.carried + pair, :size + 1] = ap[:, ap.shape[1] - size - 1:]
                        used.scales(c, row, pair, scale[:, h:])
            last = left, left_held, left_heads
            yield from used.chunk(c, hist, held, heads)
        yield from used.close()
    return run


class _Heads:
    """Adds the left edges to the rows."""

    def __init__(self, spec: HsmmSpec):
        self.spec = spec

    def scales(self, c, rows, pair, scale):
        pass

    def chunk(self, c: Chunk, hist, held, heads):
        symbols = np.arange(hist.shape[1]) < held[:, None]
        states = np.arange(heads.shape[1]) <= np.repeat(held, c.counts)[:, None]
        yield _with(c.batch, FORWARD, _filled(hist, symbols, held), _filled(heads, states, c.counts * (held + 1) * self.spec.m))

    def close(self):
        return ()


def _with_heads(params: dict, spec: HsmmSpec, choice: Choice):
    return forward_blocks(params, spec, choice, lambda: _Heads(spec))


def _with_tails(params: dict, spec: HsmmSpec, choice: Choice):
    keep, m = spec.d - 1, spec.m

    def run(batches):
        models, last = Models(params, choice), None
        for c in _chunks(batches, models, spec):
            n = len(c.on)
            following, held, end = np.zeros((n, keep), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            tails = np.zeros((len(c.model), keep, m))
            left, left_held, left_end = np.zeros((n + 1, keep), np.int64), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
            if c.carried:
                left[0], left_held[0], left_end[0] = (x[-1] for x in last[:3])
            left_tails = c.room(None if last is None else last[3], keep, m)
            for wave in c.waves():
                held[wave] = np.where(c.on[wave], left_held[wave], 0)
                following[wave] = left[wave]
                final = c.obs.values[c.obs.starts[wave] + c.obs.sizes[wave] - 1]
                end[wave] = left_end[wave + 1] = np.where(c.on[wave], left_end[wave], final)
                for rows, (t_len, f, on) in _groups(wave, c.obs.sizes[wave], held[wave], c.on[wave]):
                    joined = np.concatenate([c.obs.take(rows, t_len), following[rows, :f]], axis=1)
                    look, size = c.places(rows, joined), min(keep, t_len + f)
                    left[rows + 1, :size], left_held[rows + 1] = joined[:, :size], size
                    for at, pair in c.pairs(rows, t_len + f):
                        model, row = c.model[pair], rows[at]
                        _, a, p = models.stack(model)
                        after = c.handed(left_tails, row, pair)[:, :f] if on else None
                        u = kernel.segments(c.table[look[at], model[:, None]], spec.d)
                        beta, _, _ = kernel.backward_block(a, p, u, after)
                        if on:
                            tails[pair, :f] = after
                            beta = np.concatenate([beta, after], axis=1)
                        left_tails[c.carried + pair, :size] = beta[:, :size]
            last = left, left_held, left_end, left_tails
            symbols, states = (np.arange(keep) < x[:, None] for x in (held, np.repeat(held, c.counts)))
            yield _with(c.batch, BACKWARD, _filled(following, symbols, held), _filled(tails, states, c.counts * held * m, c.on),
                        pa.array(end))
    return run


class Block:
    """All recursions of the blocks of one shape in a wave, a place per (row, model)
    pair: ``model`` its place in ``models.keys``, ``number`` that of the pair among
    all of the task (``since`` to ``upto`` are open), ``t0``, ``obs`` (N, T)."""

    __slots__ = ("models", "model", "stack", "chunk", "rows", "number", "since", "upto", "t0", "first", "last", "obs", "u",
                 "alpha", "ap", "scale", "beta", "bp", "gamma", "durations")


def _blocks(params: dict, spec: HsmmSpec, choice: Choice) -> Callable:
    """Generator of ``Block`` objects over rows of ``BACKWARD`` in order."""
    m, dd = spec.m, spec.d

    def run(batches) -> Iterator[Block]:
        models, carry = Models(params, choice), None
        for c in _chunks(batches, models, spec):
            hist, heads, following, tails = (_Lists(c.batch.column(x)) for x in ("hist", "heads", "next", "tails"))
            end = c.batch.column("end").to_numpy(zero_copy_only=False).astype(np.int64)
            carry = c.room(carry, 3, m)  # gamma, alpha and the end beta
            for wave in c.waves():
                for rows, (t_len, h, f, first, known, go_on) in _groups(
                        wave, c.obs.sizes[wave], hist.sizes[wave], following.sizes[wave], c.t0[wave] == 0, heads.valid[wave], tails.valid[wave]):
                    obs = c.obs.take(rows, t_len)
                    joined = np.concatenate([hist.take(rows, h), obs, following.take(rows, f)], axis=1).astype(np.int64)
                    look, look_end = c.places(rows, joined), c.places(rows, end[rows, None])
                    for at, pair in c.pairs(rows, h + t_len + f):
                        x = Block()
                        row, model = rows[at], c.model[pair]
                        nth = pair - c.start[row]  # model of its row
                        pi, a, p = x.stack = models.stack(model)
                        x.models, x.model, x.chunk, x.rows, x.t0, x.obs = models, model, c, row, c.t0[row], obs[at]
                        x.number, x.since, x.upto = c.number[row] + nth, c.since, c.upto
                        x.first, x.last = bool(first), not go_on
                        e = c.table[look[at], model[:, None]]
                        left = heads.take(row, (h + 1) * m, nth * (h + 1) * m).reshape(-1, h + 1, m) if known else kernel.l1(pi)[:, None]
                        right = None if x.last else tails.take(row, f * m, nth * f * m).reshape(-1, f, m)
                        u = kernel.segments(e[:, :h + t_len], dd)
                        alpha, ap, scale, _ = kernel.forward(pi, a, p, u, left)
                        ahead = kernel.segments(e[:, h:], dd)
                        beta, bp, beta_before = kernel.backward_block(a, p, ahead, right)
                        if x.first:
                            whole = beta if x.last else np.concatenate([beta, right], axis=1)
                            bp[:, 0], end_beta = kernel.backward_end(a, p, ahead, whole, c.table[look_end[at, 0], model])
                        else:
                            g, before, end_beta = c.handed(carry, row, pair).transpose(1, 0, 2)
                        if x.last:
                            beta[:, -1] = end_beta
                        x.alpha, x.ap, x.scale = alpha[:, h:], ap[:, h:], scale[:, h:]
                        x.beta, x.bp, x.u = beta, bp, u[:, h:]
                        padded = np.concatenate([np.zeros((len(model), h, m)), beta], axis=1)
                        x.durations = lambda ap=ap, p=p, u=u, beta=padded, h=h: kernel.duration_posterior(ap, p, u, beta)[:, h:]
                        gamma = np.zeros_like(x.alpha)
                        with np.errstate(invalid="ignore", over="ignore"):
                            for t in range(t_len):
                                if x.last and t == t_len - 1:
                                    g = kernel.l1(x.alpha[:, t])
                                elif x.first and t == 0:
                                    g = kernel.l1(pi * bp[:, 0])
                                else:
                                    al, be = (x.alpha[:, t - 1], beta[:, t - 1]) if t else (before, beta_before)
                                    g = kernel.l1(g + x.ap[:, t] * bp[:, t] - al * be)
                                gamma[:, t] = g
                        x.gamma = gamma
                        carry[c.carried + pair] = np.stack([g, x.alpha[:, -1], end_beta], axis=1)
                        yield x
    return run


def sorted_parts(parts: DataFrame, descending: bool = False) -> DataFrame:
    place = F.col("t0").desc() if descending else F.col("t0")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, place)


def part_rows(rows: DataFrame, where: str = "not whole") -> DataFrame:
    """The blocks of sequences that stand in several rows, as ``PART``."""
    local = [F.lit(None).cast("array<int>").alias("local"), F.lit(None).cast("array<double>").alias("cells")]
    return rows.where(where).select("cls", "rid", "kfold", F.col("workitem").cast("string").alias("workitem"), "t0", "obs", *local)


def has_parts(rows: DataFrame) -> bool:
    return "whole" in rows.columns and not rows.where("not whole").isEmpty()


def whole_rows(rows: DataFrame) -> DataFrame:
    """Rows that hold a whole sequence; plain arrays have no column for it."""
    found = rows.where("whole") if "whole" in rows.columns else rows
    return found.where(F.size("obs") > 0)


def with_edges(parts: DataFrame, params: dict, spec: HsmmSpec, choice: Choice) -> DataFrame:
    """Blocks with the states at both edges (passes 1 and 2)."""
    left = sorted_parts(parts).mapInArrow(_with_heads(params, spec, choice), FORWARD)
    return sorted_parts(left, descending=True).mapInArrow(_with_tails(params, spec, choice), BACKWARD)


def consume_blocks(parts: DataFrame, params: dict, spec: HsmmSpec, choice: Choice, consumer, schema: str) -> DataFrame:
    """All three passes; ``consumer()`` gives an object per task with
    ``block(Block)`` and ``close()``, both iterators of Arrow batches."""
    blocks = _blocks(params, spec, choice)

    def run(batches):
        used = consumer()
        for block in blocks(batches):
            yield from used.block(block)
        yield from used.close()
    return sorted_parts(with_edges(parts, params, spec, choice)).mapInArrow(run, schema)


# ---------------------------------------------------------------- E-step sums

def add_by_model(total: np.ndarray, model: np.ndarray, values: np.ndarray) -> None:
    """total[model] += values, for sorted ``model``."""
    if len(model):
        starts = np.flatnonzero(np.append(True, model[1:] != model[:-1]))
        total[model[starts]] += np.add.reduceat(values, starts, axis=0)


def _by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of ``values`` (N, M) of each."""
    known, at = np.unique(keys, return_inverse=True)
    at = at.ravel()
    return known, np.stack([np.bincount(at, weights=v, minlength=len(known)) for v in values.T], axis=1)


class Open:
    """Running sums of the pairs whose sequences are not at their end."""

    def __init__(self):
        self.tables: dict = {}

    def add(self, x: Block, name: str, value: np.ndarray) -> np.ndarray | None:
        """The sum over all blocks, at the last one."""
        if x.first and x.last:
            return value
        since, held = self.tables.get(name, (x.since, np.zeros((0, *value.shape[1:]))))
        if x.upto > since + len(held):
            kept = held[x.since - since:]
            held, since = np.concatenate([kept, np.zeros((x.upto - x.since - len(kept), *value.shape[1:]))]), x.since
            self.tables[name] = since, held
        at = x.number - since
        held[at] = value if x.first else held[at] + value
        return held[at] if x.last else None


class EStep:
    """Adds up the estimates of each sequence per model. ``dense`` keeps a sum
    for every symbol; otherwise the emission estimates of the symbols that occur
    are given out as they come."""

    def __init__(self, spec: HsmmSpec, skip_undefined: bool, emit, dense: bool = True):
        self.spec, self.skip, self.emit, self.dense = spec, skip_undefined, emit, dense
        self.open, self.keys, self.totals, self.seen = Open(), [], {}, None
        # emission sums (pair and symbol, by state) of open sequences, the pairs that
        # have ended, and estimates (model and symbol, by state) to be given out
        self.pieces: list = []
        self.ended: list = []
        self.sparse: list = []
        self.chunk = None
        self.merged = self.cells = 0

    def block(self, x: Block):
        spec = self.spec
        if x.chunk is not self.chunk:
            self.settle()
            self.chunk = x.chunk
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.log(x.scale).sum(axis=1)
        found = {"a": kernel.transition_posterior(x.alpha, x.stack[1], x.bp).sum(axis=1), "p": x.durations().sum(axis=1),
                 "g": x.gamma.sum(axis=1), "score": score, "g0": x.gamma[:, 0] if x.first else np.zeros((len(x.model), spec.m))}
        if self.dense:
            found["b"] = kernel.symbol_sums(x.obs, x.gamma, spec.k)
        else:
            keys, num_b = _by_key((np.arange(len(x.model))[:, None] * spec.k + x.obs).ravel(), x.gamma.reshape(-1, spec.m))
            if not (x.first and x.last):
                self.pieces.append((x.number[keys // spec.k] * spec.k + keys % spec.k, num_b))
        st = {name: self.open.add(x, name, v) for name, v in found.items()}
        if not x.last:
            return
        if self.dense or x.first:
            self.add(x.models, x.model, st, *(() if self.dense else (keys // spec.k, keys % spec.k, num_b)))
        else:
            self.ended.append((x.models, x.number, x.model, st))
        if self.cells > CELL_BUDGET // 8:
            yield self.give()

    def settle(self) -> None:
        """Adds the sequences of several blocks that have ended since the last time."""
        size = sum(len(keys) for keys, _ in self.pieces)
        if not self.pieces or not self.ended and size < max(2 * self.merged, CELL_BUDGET // 8):
            return
        k = self.spec.k
        keys, num_b = _by_key(*(np.concatenate([piece[i] for piece in self.pieces]) for i in (0, 1)))
        if self.ended:
            number = np.concatenate([x[1] for x in self.ended])
            order = np.argsort(number)
            at = np.searchsorted(number[order], keys // k)
            over = number[order][np.minimum(at, len(number) - 1)] == keys // k
            st = {name: np.concatenate([x[3][name] for x in self.ended])[order] for name in self.ended[0][3]}
            self.add(self.ended[0][0], np.concatenate([x[2] for x in self.ended])[order], st, at[over], keys[over] % k, num_b[over])
            keys, num_b = keys[~over], num_b[~over]
        self.pieces, self.ended, self.merged = [(keys, num_b)] if len(keys) else [], [], len(keys)

    def add(self, models: Models, model: np.ndarray, st: dict, at=None, symbol=None, num_b=None) -> None:
        """Sequences at their end. Emission sums that are not dense come as cells:
        place in ``model``, symbol and (N, M) sums."""
        pi, a, p = kernel.new_initial(st["g0"]), kernel.new_transition(st["a"]), kernel.new_duration(st["p"])
        wrong = np.isnan(pi).any(axis=1) | np.isnan(a).any(axis=(1, 2)) | np.isnan(p).any(axis=(1, 2))
        if self.dense:
            b = kernel.new_emission(st["b"], st["g"])
            wrong |= np.isnan(b).any(axis=(1, 2))
        else:
            b = kernel.new_emission_cells(num_b, st["g"], at)
            wrong[at[np.isnan(b).any(axis=1)]] = True
        good = ~wrong if self.skip else np.ones(len(model), dtype=bool)
        values = {"loglik": st["score"], "n_seq": np.ones(len(model)), "n_undefined": 1.0 * (~good | ~np.isfinite(st["score"])),
                  "pi": pi, "a": a, "p": p} | ({"b": b} if self.dense else {})
        if self.seen is None:
            self.keys, self.seen = models.keys, np.zeros(len(models.keys), dtype=bool)
            self.totals = {name: np.zeros((len(models.keys), *v.shape[1:])) for name, v in values.items()}
        self.seen[model] = True
        order = np.argsort(model, kind="stable")
        for name, v in values.items():
            used = order if name == "n_undefined" else order[good[order]]
            add_by_model(self.totals[name], model[used], v[used])
        if not self.dense:
            used = good[at]
            cells = _by_key(model[at[used]] * self.spec.k + symbol[used], b[used])
            self.sparse.append(cells)
            self.cells += cells[1].size

    @property
    def sums(self) -> dict:
        seen = [] if self.seen is None else np.flatnonzero(self.seen)
        return {self.keys[n]: {name: v[n] for name, v in self.totals.items()} for n in seen}

    def give(self) -> pa.RecordBatch:
        """The emission estimates since the last time, summed per cell."""
        keys, values = _by_key(*(np.concatenate([x[i] for x in self.sparse]) for i in (0, 1)))
        self.sparse, self.cells = [], 0
        m, k = self.spec.m, self.spec.k
        model = np.array(self.keys, dtype=np.int32).reshape(-1, 2)[np.repeat(keys // k, m)]
        columns = [model[:, 0], model[:, 1], np.full(len(model), "b"), np.tile(np.arange(m), len(keys)), np.repeat(keys % k, m), values.ravel()]
        schema = _schema("fold int, cls int, param string, i int, j int, value double")
        return pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    def close(self):
        self.settle()
        if self.seen is not None:
            yield self.emit(self.sums, self.spec)
        if self.sparse:
            yield self.give()
