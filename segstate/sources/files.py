"""Small files on the cluster's file system, written by the driver.

Used for what is bounded by the run and not by the data: log rows, manifests
and the model rows of one iteration. Any file system that Spark can reach works.
"""

from __future__ import annotations

import io
import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; an absent folder has none."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def status(spark: SparkSession, path: str) -> tuple[int, int]:
    """(length, modification time) of a file."""
    fs, p = _fs(spark, path)
    s = fs.getFileStatus(p)
    return s.getLen(), s.getModificationTime()


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file under a temporary name and renames it, so that the name
    appears with all its bytes or not at all."""
    fs, p = _fs(spark, path)
    tmp = p.suffix("._tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"could not rename {tmp} to {path}")


def read(spark: SparkSession, path: str) -> bytes:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_parquet(spark: SparkSession, path: str, table: pa.Table) -> None:
    buffer = io.BytesIO()
    pq.write_table(table, buffer, compression="snappy")
    write(spark, path, buffer.getvalue())


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write(spark, path, (json.dumps(value, sort_keys=True) + "\n").encode())


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read(spark, path))
