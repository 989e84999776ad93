"""What a work folder was made with.

The manifest of a run holds its parameters and a fingerprint of its input. It is
written before anything else and compared before anything is reused: a folder
made with another seed, sample, fold number, epsilon, model size or input raises,
and names what differs.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from segstate.sources import files
from segstate.spec import RunParams


class ManifestMismatch(ValueError):
    """The work folder belongs to another run."""


def input_fingerprint(seqs: DataFrame) -> str:
    """Digest of the names, lengths and times of the files that are read; of the
    schema, for data that comes from no file."""
    spark = seqs.sparkSession
    lines = [seqs.schema.simpleString()]
    for path in sorted(seqs.inputFiles()):
        lines.append(":".join([path, *map(str, files.status(spark, path))]))
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def describe(params: RunParams, fingerprint: str) -> dict:
    spec = params.spec
    return {"m": spec.m, "k": spec.k, "d": spec.d, "folds": params.folds, "seed": params.seed,
            "sample_fraction": params.sample_fraction, "epsilon": params.epsilon, "max_iterations": params.max_iterations,
            "feedback_duration": params.feedback_duration, "smoothing": params.smoothing,
            "skip_undefined": params.skip_undefined, "input": fingerprint}


def check(spark: SparkSession, work_dir: str, wanted: dict) -> None:
    """Writes the manifest of a new folder; raises if the folder has another."""
    path = os.path.join(work_dir, "manifest.json")
    if not files.exists(spark, path):
        files.write_json(spark, path, wanted)
        return
    found = files.read_json(spark, path)
    differ = sorted(k for k in found.keys() | wanted.keys() if found.get(k) != wanted.get(k))
    if differ:
        raise ManifestMismatch(f"{work_dir} was made with other " + ", ".join(
            f"{k} ({found.get(k)}, now {wanted.get(k)})" for k in differ))
