"""Session helpers: defaults for local runs, shared work folder for tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8,
              app: str = "segstate") -> SparkSession:
    """Local session used by tests and the bench (a cluster passes its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only when it is unset (local tests) a fresh folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None) or \
            sc.getConf().get("spark.checkpoint.dir", None)
        if not current and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not current:
            current = tempfile.mkdtemp(prefix="segstate-ckpt-", dir="/tmp")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir() or current
    return current


class WorkScope:
    """Tables that a run makes and that are gone when it ends.

    Inside ``with WorkScope(spark) as scope`` every folder of ``new_work_dir``
    belongs to the scope and is deleted at its end, also after a failure, but for
    those given to ``keep``. Scopes nest; a folder belongs to the innermost one."""

    _open: list[WorkScope] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> WorkScope:
        WorkScope._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        WorkScope._open.remove(self)
        for path in self.paths:
            if path not in self.kept:
                _delete(self.spark, path)

    def keep(self, path: str) -> str:
        self.kept.add(path)
        return path

    def result(self, df):
        """``df`` as it is if the scope has made no table, else written to a
        folder that outlives the scope."""
        if not self.paths:
            return df
        path = self.keep(new_work_dir(self.spark, "result"))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_work_dir(spark: SparkSession, name: str = "run") -> str:
    """A fresh folder for the tables of one run, under the checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "segstate", f"{name}-{uuid.uuid4().hex[:12]}")
    if WorkScope._open:
        WorkScope._open[-1].paths.append(path)
    return path


def materialize(df, name: str = "table"):
    """Write ``df`` as Parquet under the shared work folder and read it back:
    later stages scan a small stored table instead of re-running its
    lineage, and a lost executor recomputes nothing before it."""
    path = os.path.join(new_work_dir(df.sparkSession, name), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
