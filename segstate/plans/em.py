"""EM training of every (fold, class) model in the same Spark jobs.

Per iteration one job runs the E-step of all running models over the stored fold
table and sums the estimates (two-phase aggregate). The sums of a model are
M + M^2 + M K + M D numbers, so the driver fetches them, applies the M-step and the
stop test, and writes the rows of the iteration.

*Trace.* An iteration is a data file and one row of an append-only log (iteration,
path, status). The data file is written first; the log row then appears under its
final name with all its bytes or not at all. A resume reads the log once and
takes what it lists, so a file that was written but never logged does not count,
and restores all parameters and the previous log-likelihood.

Models whose emission matrix is above the limit for tables that travel with the
tasks keep it as a table of cells, joined to the symbols (``operators.wide``); the
cells of an iteration are part of its data and are written before its log row.

Kept semantics: the E-step always uses the *start* duration matrix P (Q4)
while the returned P is the last estimate; the stop test is F9 on the summed
log-likelihood, with -Infinity before the first iteration.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstate.functions.params import EPS_2_52, init_model_values, init_models
from segstate.operators import blockpass, kernel
from segstate.operators.estep import partial_sums
from segstate.operators.joins import broadcast_limit
from segstate.sources import files
from segstate.sources.store import is_complete
from segstate.spec import HsmmSpec

TRACE_SCHEMA = ("fold int, cls int, iteration int, m int, k int, d int, pi array<double>, a array<array<double>>, "
                "b array<array<double>>, p array<array<double>>, loglik double, prev_loglik double, n_seq long, "
                "n_undefined long, converged boolean, status string")
TRACE_COLS = [c.split()[0] for c in TRACE_SCHEMA.split(", ")]
LOG_SCHEMA = "iteration int, path string, status string"
_VEC, _MAT = pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))
_ARROW = pa.schema([(c, {"pi": _VEC, "a": _MAT, "b": _MAT, "p": _MAT, "loglik": pa.float64(), "prev_loglik": pa.float64(),
                         "n_seq": pa.int64(), "n_undefined": pa.int64(), "converged": pa.bool_(), "status": pa.string()}.get(c, pa.int32()))
                    for c in TRACE_COLS])


# ------------------------------------------------------------------ the trace

def read_log(spark: SparkSession, work_dir: str) -> list:
    """Rows (iteration, path, status) of the iterations that were committed."""
    folder = os.path.join(work_dir, "trace", "log")
    # one listing; a row that was not renamed into place is no row
    if not any(n.endswith(".json") for n in files.names(spark, folder)):
        return []
    rows = spark.read.schema(LOG_SCHEMA).option("pathGlobFilter", "*.json").json(folder).collect()
    return sorted(rows, key=lambda r: r.iteration)


def read_trace(spark: SparkSession, work_dir: str, log: list | None = None) -> DataFrame | None:
    """All committed iterations, or None when there are none."""
    log = read_log(spark, work_dir) if log is None else log
    if not log:
        return None
    return spark.read.schema(TRACE_SCHEMA).parquet(*[os.path.join(work_dir, "trace", r.path) for r in log])


def commit(spark: SparkSession, work_dir: str, iteration: int, rows: list[dict], running: bool) -> None:
    """Writes the rows of an iteration, then its log row."""
    path = f"rows-{iteration:06d}.parquet"
    folder = os.path.join(work_dir, "trace")
    files.write_parquet(spark, os.path.join(folder, path), pa.Table.from_pylist(rows, schema=_ARROW))
    files.write_json(spark, os.path.join(folder, "log", f"{iteration:06d}.json"),
                     {"iteration": iteration, "path": path, "status": "running" if running else "done"})


def last_rows(trace: DataFrame) -> DataFrame:
    """S7 restore: the latest trace row of every model."""
    latest = F.max_by(F.struct(*[c for c in TRACE_COLS if c not in ("fold", "cls")]), F.col("iteration"))
    return trace.groupBy("fold", "cls").agg(latest.alias("r")).select("fold", "cls", "r.*")


def stopped(loglik: float, previous: float | None, epsilon: float) -> bool:
    """F9 on the driver; a comparison with NaN is false."""
    previous = float("-inf") if previous is None else previous
    with np.errstate(invalid="ignore", divide="ignore"):
        change = np.abs(np.float64(loglik) - previous) / ((np.abs(loglik) + np.abs(previous) + EPS_2_52) / 2)
    return bool(change < epsilon)


# ----------------------------------------------------------------- the M-step

def gather(cells: list, spec: HsmmSpec) -> dict:
    """(fold, cls) -> sums as arrays from rows (fold, cls, param, i, j, value)."""
    shapes = {"pi": (spec.m, 1), "a": (spec.m, spec.m), "b": (spec.m, spec.k), "p": (spec.m, spec.d)}
    out: dict = {}
    for r in cells:
        s = out.setdefault((r.fold, r.cls), {})
        if r.param not in shapes:
            s[r.param] = r.value
        else:
            s.setdefault(r.param, np.zeros(shapes[r.param]))[r.i, r.j] = r.value
    return out


def maximise(sums: dict, smoothing: float = 0.0) -> tuple:
    """R11 for one model: new pi, a, b (None if it is kept as cells), p."""
    p = sums["p"] + smoothing
    with np.errstate(invalid="ignore", divide="ignore"):
        p = p * (1.0 / np.float64(p.sum()))
    return (kernel.l1(sums["pi"][:, 0] + smoothing), kernel.l1(sums["a"] + smoothing, axis=1),
            kernel.l1(sums["b"] + smoothing, axis=1) if "b" in sums else None, p)


# ---------------------------------------------------------------- the EM loop

INIT_SCHEMA = ("fold int, cls int, m int, k int, d int, pi array<double>, a array<array<double>>, "
               "b array<array<double>>, p array<array<double>>")


class _Emissions:
    """Where the emission matrices of the running models are: in the driver's
    parameters, or in a table of cells per iteration."""

    def __init__(self, spark: SparkSession, work_dir: str, spec: HsmmSpec, n_models: int):
        self.spark, self.folder, self.spec = spark, os.path.join(work_dir, "trace"), spec
        self.wide = n_models * spec.model_row_bytes() > broadcast_limit(spark)

    def path(self, iteration: int) -> str:
        return os.path.join(self.folder, f"cells-{iteration:06d}")

    def cells(self, iteration: int) -> DataFrame:
        return self.spark.read.schema("fold int, cls int, sym int, e array<double>").parquet(self.path(iteration))


def _start(folded: DataFrame, spec: HsmmSpec, k: int, seed: int, work_dir: str, start: DataFrame | None) -> DataFrame:
    """The start models, stored once."""
    spark, path = folded.sparkSession, os.path.join(work_dir, "init")
    if not is_complete(spark, path):
        if start is None:
            classes = sorted(r[0] for r in folded.select("cls").distinct().collect())
            keys = [(f, c) for c in classes for f in range(k)]
            if len(keys) * spec.model_row_bytes() > broadcast_limit(spark):
                start = init_models(spark.createDataFrame(keys, "fold int, cls int").repartition(max(1, len(keys))), spec, seed)
            else:
                # a pure function of (seed, fold, cls), evaluated on the driver
                rows = [(f, c, spec.m, spec.k, spec.d, *(v[x] for x in ("pi", "a", "b", "p")))
                        for f, c in keys for v in [init_model_values(f, c, spec, seed)]]
                start = spark.createDataFrame(rows, INIT_SCHEMA)
        start.select("fold", "cls", "m", "k", "d", "pi", "a", "b", "p").write.mode("overwrite").parquet(path)
    return spark.read.schema(INIT_SCHEMA).parquet(path)


def train_models(folded: DataFrame, spec: HsmmSpec, k: int, seed: int, work_dir: str,
                 epsilon: float = 1e-4, max_iterations: int = 10_000,
                 start: DataFrame | None = None,
                 feedback_duration: bool = False, smoothing: float = 0.0,
                 skip_undefined: bool = False) -> DataFrame:
    """Train every (fold, cls) model; returns the final model table
    (fold, cls, m, k, d, pi, a, b, p, loglik, iteration, converged, status).
    ``folded`` has cls, kfold, obs (and rid, t0, whole for sequences in blocks).

    Defaults reproduce the reference: the E-step keeps the start P
    (``feedback_duration=True`` feeds the estimated P back), no smoothing,
    and an undefined sequence poisons its model's sums (``skip_undefined``
    leaves it out and counts it). ``status`` is ``converged``, ``diverged`` (a
    parameter or the log-likelihood is not a number, so no later iteration can
    change it) or ``running`` (cut by ``max_iterations``)."""
    if spec.d < 2:
        raise ValueError("D must be at least 2: duration column 0 carries no forward mass")
    if max_iterations < 1:
        raise ValueError("max_iterations must be at least 1")
    spark = folded.sparkSession
    init = _start(folded, spec, k, seed, work_dir, start)
    names = ("pi", "a", "p")
    small = init.select("fold", "cls", *names).collect()
    if not small:
        raise ValueError("no model to train: empty training data")
    emissions = _Emissions(spark, work_dir, spec, len(small))
    p_start = {(r.fold, r.cls): np.array(r.p) for r in small}
    params = {(r.fold, r.cls): (np.array(r.pi), np.array(r.a), None, np.array(r.p)) for r in small}
    logliks: dict = dict.fromkeys(params)
    statuses = dict.fromkeys(params, "running")

    log = read_log(spark, work_dir)
    trace, first = read_trace(spark, work_dir, log), 0
    source = init if trace is None else last_rows(trace)
    if trace is not None:
        first = log[-1].iteration + 1
        for r in source.select("fold", "cls", *names, "loglik", "status").collect():
            params[r.fold, r.cls] = (np.array(r.pi), np.array(r.a), None, np.array(r.p))
            logliks[r.fold, r.cls], statuses[r.fold, r.cls] = r.loglik, r.status
    if not emissions.wide:
        for r in source.select("fold", "cls", "b").collect():
            pi, a, _, p = params[r.fold, r.cls]
            params[r.fold, r.cls] = (pi, a, np.array(r.b), p)
    elif trace is None:
        from segstate.operators.wide import emission_cells
        emission_cells(init).write.mode("overwrite").parquet(emissions.path(-1))

    parts = blockpass.has_parts(folded)
    for it in range(first, max_iterations):
        running = sorted(key for key, s in statuses.items() if s == "running")
        if not running:
            break
        used = {key: (*params[key][:3], params[key][3] if feedback_duration else p_start[key]) for key in running}
        cells = _sums(folded, used, spec, k, skip_undefined, parts, emissions, it)
        sums = gather(cells, spec)
        missing = sorted(set(running) - {key for key, s in sums.items() if s.get("n_seq") or s.get("n_undefined")})
        if missing:  # Q19: nothing to estimate from
            raise ValueError(f"empty training split for (fold, cls) {missing[:5]}")
        bad_cells = _next_cells(emissions, it, running, statuses, smoothing) if emissions.wide else {}
        rows = []
        for key in running:
            s = sums[key]
            params[key] = maximise(s, smoothing)
            previous, logliks[key] = logliks[key], s["loglik"]
            undefined = np.isnan(s["loglik"]) or key in bad_cells or any(np.isnan(x).any() for x in params[key][:3] if x is not None)
            converged = stopped(s["loglik"], previous, epsilon)
            statuses[key] = "converged" if converged else "diverged" if undefined else "running"
            pi, a, b, p = (None if x is None else x.tolist() for x in params[key])
            rows.append({"fold": key[0], "cls": key[1], "iteration": it, "m": spec.m, "k": spec.k, "d": spec.d, "pi": pi, "a": a,
                         "b": b, "p": p, "loglik": s["loglik"], "prev_loglik": previous, "n_seq": int(s["n_seq"]),
                         "n_undefined": int(s["n_undefined"]), "converged": converged, "status": statuses[key]})
        commit(spark, work_dir, it, rows, any(s == "running" for s in statuses.values()))

    trace = read_trace(spark, work_dir)
    final = last_rows(trace).select("fold", "cls", "m", "k", "d", "pi", "a", "b", "p", "loglik", "iteration", "converged", "status")
    if emissions.wide:
        from segstate.operators.wide import model_rows
        last = read_log(spark, work_dir)[-1].iteration
        final = model_rows(final.drop("b"), emissions.cells(last), spec).select(*final.columns)
    return final


def _sums(folded: DataFrame, used: dict, spec: HsmmSpec, k: int, skip_undefined: bool, parts: bool, emissions: _Emissions,
          it: int) -> list:
    """The sums of an iteration, bounded by the number of models. Those of the
    emission matrix stay a table if it is wide."""
    if not emissions.wide:
        return (partial_sums(folded, used, spec, k, skip_undefined, parts)
                .groupBy("fold", "cls", "param", "i", "j").agg(F.sum("value").alias("value")).collect())
    from segstate.operators.wide import wide_sums
    path = os.path.join(emissions.folder, f"sums-{it:06d}")
    wide_sums(folded, used, emissions.cells(it - 1), spec, skip_undefined).write.mode("overwrite").parquet(path)
    sums = emissions.spark.read.parquet(path)
    return sums.where("param <> 'b'").collect()


def _next_cells(emissions: _Emissions, it: int, running: list, statuses: dict, smoothing: float) -> dict:
    """Writes the emission cells after the iteration and names the models that
    hold one that is not a number. Models that have ended keep their cells."""
    from segstate.operators.wide import wide_m_step
    spark, path = emissions.spark, os.path.join(emissions.folder, f"sums-{it:06d}")
    new = wide_m_step(spark.read.parquet(path), emissions.spec, running, smoothing)
    ended = [f"{f}:{c}" for (f, c), s in statuses.items() if s != "running"]
    if ended:
        new = new.unionByName(emissions.cells(it - 1).where(F.concat_ws(":", "fold", "cls").isin(ended)))
    new.write.mode("overwrite").parquet(emissions.path(it))
    bad = emissions.cells(it).where(F.exists("e", F.isnan)).select("fold", "cls").distinct().collect()
    files.delete(spark, path)
    return {(r.fold, r.cls): True for r in bad}
