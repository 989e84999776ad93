"""The passes over blocks in this process: many sequences in one kernel call."""
import numpy as np
import pyarrow as pa
import pytest

from segstate.operators import blockpass, kernel, scoring
from segstate.operators.estep import _emit
from segstate.spec import HsmmSpec

SPEC = HsmmSpec(m=2, k=6, d=4)
FOLDS = 3


def _models(rng):
    def l1(*shape):
        x = rng.random(shape) + 0.05
        return x / x.sum(axis=-1, keepdims=True)
    return {(f, c): (l1(2), l1(2, 2), l1(2, SPEC.k), l1(2, SPEC.d) / 2) for f in range(FOLDS) for c in (0, 1)}


def _sequences(rng, n, longest=14):
    return [(i % 2, i, i % FOLDS, rng.integers(0, SPEC.k, rng.integers(1, longest + 1))) for i in range(n)]


def _rows(sequences, block, params=None):
    """``PART`` rows; with ``params`` they bring the emissions of their symbols."""
    rows = []
    for cls, rid, kfold, obs in sorted(sequences, key=lambda x: x[:2]):
        local = cells = None
        if params:
            local = np.unique(obs).tolist()
            cells = np.stack([params[k][2][:, local].T for k in sorted(params)], axis=1).ravel().tolist()
        rows += [(cls, rid, kfold, f"w{rid}", t, obs[t:t + block].tolist(), local, cells) for t in range(0, len(obs), block)]
    schema = blockpass._schema(blockpass.PART)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _split(table, size):
    return table.combine_chunks().to_batches(max_chunksize=size)


def _edges(rows, params, size):
    choice = blockpass.trained_by(params)
    left = pa.Table.from_batches(blockpass._with_heads(params, SPEC, choice)(_split(rows, size)))
    left = left.sort_by([("cls", "ascending"), ("rid", "ascending"), ("t0", "descending")])
    both = pa.Table.from_batches(blockpass._with_tails(params, SPEC, choice)(_split(left, size)))
    return both.sort_by([("cls", "ascending"), ("rid", "ascending"), ("t0", "ascending")])


def _sums(rows, params, size, dense):
    used, out = blockpass.EStep(SPEC, False, _emit, dense), []
    for x in blockpass._blocks(params, SPEC, blockpass.trained_by(params))(_split(_edges(rows, params, size), size)):
        out += used.block(x)
    out += used.close()
    found = {}
    for *key, value in (r.values() for batch in out for r in batch.to_pylist()):
        found[tuple(key)] = found.get(tuple(key), 0.0) + value
    return found


def _plain(sequences, params):
    found = {}
    for cls, _, kfold, obs in sequences:
        for f in (f for f in range(FOLDS) if f != kfold):
            values = kernel.e_step(obs[None], SPEC.k, *(x[None] for x in params[f, cls]))
            for name, v in zip(("loglik", "pi", "a", "b", "p"), values, strict=True):
                for (i, j), cell in np.ndenumerate(v[0].reshape((*v.shape[1:], 1, 1)[:2])):
                    found[f, cls, name, i, j] = found.get((f, cls, name, i, j), 0.0) + cell
            found[f, cls, "n_seq", 0, 0] = found.get((f, cls, "n_seq", 0, 0), 0.0) + 1
    return found


def _params_without_b(params):
    return {key: (pi, a, None, p) for key, (pi, a, _, p) in params.items()}


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize(("block", "size", "budget"), [(4, 10_000, 2_000_000), (4, 3, 2_000_000), (1, 5, 2_000_000), (4, 7, 1), (40, 50, 200)])
def test_sums_of_any_cut(monkeypatch, block, size, budget, wide):
    """Sequences go on over Arrow batches, chunks and kernel calls."""
    rng = np.random.default_rng(5)
    params, sequences = _models(rng), _sequences(rng, 60)
    monkeypatch.setattr(blockpass, "CELL_BUDGET", budget)
    if wide:
        got = _sums(_rows(sequences, block, params), _params_without_b(params), size, dense=False)
    else:
        got = _sums(_rows(sequences, block), params, size, dense=True)
    want = _plain(sequences, params)
    assert {k for k, v in want.items() if v} == {k for k, v in got.items() if v}
    for key, value in want.items():
        assert got.get(key, 0.0) == pytest.approx(value, rel=1e-9, abs=1e-12), key


@pytest.mark.parametrize(("size", "budget"), [(10_000, 2_000_000), (3, 2_000_000), (1, 1)])
def test_scores_of_any_cut(monkeypatch, size, budget):
    rng = np.random.default_rng(6)
    params, sequences, lengths = _models(rng), _sequences(rng, 30), [2, 5, None]
    monkeypatch.setattr(blockpass, "CELL_BUDGET", budget)
    out = [r for b in scoring._parts(params, SPEC, lengths)(_split(_rows(sequences, 4), size)) for r in b.to_pylist()]
    assert len(out) == len(sequences) * len(lengths)
    by = {rid: (kfold, obs) for _, rid, kfold, obs in sequences}
    for r in out:
        kfold, obs = by[int(r["workitem"][1:])]
        assert r["fold"] == kfold
        for c in (0, 1):
            want = kernel.score(obs[None, :r["t_prefix"]], *(x[None] for x in params[kfold, c]))[0]
            assert r[f"score{c}"] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("wide", [False, True])
def test_kernel_calls_follow_shapes_and_not_sequences(monkeypatch, wide):
    rng = np.random.default_rng(7)
    params, sequences = _models(rng), _sequences(rng, 800)
    rows = _rows(sequences, 4, params if wide else None)
    used = _params_without_b(params) if wide else params
    calls = []
    forward, backward = kernel.forward, kernel.backward_block
    monkeypatch.setattr(kernel, "forward", lambda *x: calls.append("forward") or forward(*x))
    monkeypatch.setattr(kernel, "backward_block", lambda *x: calls.append("backward") or backward(*x))
    _sums(rows, used, 10_000, dense=not wide)
    # two passes each over blocks of 1 to 4 symbols, first or not, last or not
    assert len(calls) < 100 < len(sequences)
