"""Typed tables of a run: sequences CSV, folds, models, scores, metrics
(S1-S8). Everything is written under one work folder on the shared file
system named by the cluster, so a restarted driver finds what was done."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segstate.functions.obs import obs_to_str, parse_obs
from segstate.sources.files import exists, names
from segstate.spec import HsmmSpec

RAW_SCHEMA = "workitem string, str_obs string"
FOLDS_SCHEMA = "workitem string, str_obs string, row_id bigint, kfold int"
SCORES_SCHEMA = "workitem string, score1 double, score0 double"


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end; a folder that an interrupted
    job left behind is not."""
    return exists(spark, f"{path}/_SUCCESS")


def has_partitions(spark: SparkSession, path: str) -> bool:
    """Whether a table that is replaced per partition holds one. Such a write
    leaves no mark of its end; its partitions appear whole."""
    return any("=" in name for name in names(spark, path))


# ---------------------------------------------------------------- S1
def write_raw_sequences(seqs: DataFrame, path: str) -> None:
    """Headerless CSV ``workitem,str_obs`` (the reference's input layout)."""
    seqs.select(F.col("workitem").cast("string"), obs_to_str(F.col("obs")).alias("str_obs")) \
        .write.mode("overwrite").csv(path)


def read_raw_lines(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """S1 with nothing lost: (workitem, cls, obs, raw). ``raw`` is the text of a
    line that has not the two columns of the layout, else null."""
    schema = RAW_SCHEMA + ", raw string"
    parts = [spark.read.schema(schema).option("columnNameOfCorruptRecord", "raw").csv(p).withColumn("cls", F.lit(c).cast("int"))
             for c, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("workitem", "cls", parse_obs(F.col("str_obs")).alias("obs"), "raw")


def read_raw_sequences(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """One headerless CSV per class -> (workitem, cls, obs), typed."""
    return read_raw_lines(spark, paths).drop("raw")


# ------------------------------------------------------------ S2 / S3
FOLD_TABLE = "rid long, workitem string, t0 long, whole boolean, obs array<int>, row_id bigint, cls int, kfold int"


def write_folds(folded: DataFrame, path: str) -> None:
    """S3: fold assignment, partitioned by class and fold (prunable). The
    observations are stored typed and in blocks, so the scans of every EM
    iteration parse nothing."""
    (folded.select("rid", F.col("workitem").cast("string"), "t0", "whole", F.col("obs").cast("array<int>"), "row_id", "kfold", "cls")
     .write.mode("overwrite").partitionBy("cls", "kfold").parquet(path))


def write_folds_csv(folded: DataFrame, path: str) -> None:
    """S3 as headerless CSV ``workitem,str_obs,row_id,kfold`` of one class."""
    (folded.select(F.col("workitem").cast("string"), obs_to_str(F.col("obs")).alias("str_obs"), "row_id", "kfold")
     .write.mode("overwrite").csv(path))


def read_folds_csv(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """S2 from headerless CSV, one path per class."""
    parts = [spark.read.schema(FOLDS_SCHEMA).csv(p).withColumn("cls", F.lit(c).cast("int"))
             for c, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("workitem", "cls", parse_obs(F.col("str_obs")).alias("obs"), "row_id", "kfold")


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """Typed read back of the fold table."""
    return spark.read.schema(FOLD_TABLE).parquet(path)


# ------------------------------------------------------------ S4 / S5
def write_scores(scores: DataFrame, path: str) -> None:
    """One folder per (t_prefix, fold, cls). Only the folders present in
    ``scores`` are replaced (dynamic partition overwrite), so a re-run after
    a failure never duplicates rows."""
    parts = [c for c in ("t_prefix", "fold", "cls") if c in scores.columns]
    (scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(path))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Typed reuse (scores stay doubles, so the comparison is numeric)."""
    return spark.read.parquet(path)


# ---------------------------------------------------------------- S6
def _col_major(mat: Column) -> Column:
    """Row-major array<array<double>> -> flat column-major array<double>."""
    n_cols = F.size(mat[0])
    return F.flatten(F.transform(F.sequence(F.lit(0), n_cols - 1),
                                 lambda j: F.transform(mat, lambda row: row[j])))


def model_to_flat(models: DataFrame) -> DataFrame:
    """S6 write form: ``fold;M;k;D;Pi;A;B;P`` with arrays ``,``-joined,
    matrices column-major (one text line per model)."""
    def txt(arr: Column) -> Column:
        return F.concat_ws(",", F.transform(arr, lambda x: x.cast("string")))
    line = F.concat_ws(";", F.col("fold").cast("string"), F.col("m").cast("string"),
                       F.col("k").cast("string"), F.col("d").cast("string"),
                       txt(F.col("pi")), txt(_col_major(F.col("a"))),
                       txt(_col_major(F.col("b"))), txt(_col_major(F.col("p"))))
    return models.select("fold", "cls", line.alias("line"))


def _from_col_major(flat: Column, rows: int, cols: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                       lambda i: F.transform(F.sequence(F.lit(0), F.lit(cols - 1)),
                                             lambda j: flat[j * rows + i]))


def model_from_flat(lines: DataFrame, spec: HsmmSpec) -> DataFrame:
    """S6 load form: text line -> typed row-major model row."""
    parts = F.split(F.col("line"), ";")

    def nums(i: int) -> Column:
        return F.transform(F.split(parts[i], ","), lambda x: x.cast("double"))
    return lines.select(
        parts[0].cast("int").alias("fold"), "cls",
        parts[1].cast("int").alias("m"), parts[2].cast("int").alias("k"), parts[3].cast("int").alias("d"),
        nums(4).alias("pi"),
        _from_col_major(nums(5), spec.m, spec.m).alias("a"),
        _from_col_major(nums(6), spec.m, spec.k).alias("b"),
        _from_col_major(nums(7), spec.m, spec.d).alias("p"),
    )


MODEL_HEADER = "kfold;M;k;D;Pi;A;B;P"


def write_model_file(models: DataFrame, path: str) -> None:
    """The models of one class as text, one line per fold under a header.
    At most k lines, so one task writes the one file."""
    lines = model_to_flat(models).select(F.col("fold").alias("at"), F.col("line").alias("value"))
    head = models.sparkSession.range(1).select(F.lit(-1).alias("at"), F.lit(MODEL_HEADER).alias("value"))
    (head.unionByName(lines).repartition(1).sortWithinPartitions("at").select("value")
     .write.mode("overwrite").text(path))


def read_model_lines(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """(cls, line) of the model files of each class, without headers and
    empty lines."""
    parts = [spark.read.text(p).select(F.lit(c).cast("int").alias("cls"), F.col("value").alias("line"))
             for c, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where((F.col("line") != MODEL_HEADER) & (F.trim("line") != ""))


def read_model_file(spark: SparkSession, paths: dict[int, str], spec: HsmmSpec,
                    fold: int | None = None) -> DataFrame:
    """The typed models of all folds, or of one. A line whose dimensions
    are not those of ``spec`` raises when it is read."""
    # tested on the line, before its arrays are cut to the shape of ``spec``
    fits = F.col("line").rlike(rf"^\d+;{spec.m};{spec.k};{spec.d};")
    lines = read_model_lines(spark, paths).withColumn("line", F.when(fits, F.col("line")).otherwise(
        F.raise_error(F.lit(f"a stored model has other dimensions than {spec}")).cast("string")))
    found = model_from_flat(lines, spec)
    return found if fold is None else found.where(F.col("fold") == fold)


def model_long(models: DataFrame) -> DataFrame:
    """Long form (fold, cls, param, i, j, value) of a model table."""
    def cells(name: str, col: Column) -> Column:
        return F.flatten(F.transform(col, lambda row, i: F.transform(
            row, lambda x, j: F.struct(F.lit(name).alias("param"), i.alias("i"), j.alias("j"),
                                       x.alias("value")))))
    pi_cells = F.transform(F.col("pi"), lambda x, i: F.struct(
        F.lit("pi").alias("param"), i.alias("i"), F.lit(0).alias("j"), x.alias("value")))
    allc = F.concat(pi_cells, cells("a", F.col("a")), cells("b", F.col("b")), cells("p", F.col("p")))
    return models.select("fold", "cls", F.explode(allc).alias("c")).select("fold", "cls", "c.*")


# ---------------------------------------------------------------- S8
def append_metrics(metrics: DataFrame, path: str) -> None:
    """One row per finished fold, or per (t_prefix, fold); what is present
    here is committed. Folders are per key and replaced idempotently."""
    (metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*[c for c in ("t_prefix", "fold") if c in metrics.columns]).parquet(path))


def pending_folds(spark: SparkSession, all_folds: DataFrame, metrics_path: str,
                  keys: list[str] | None = None) -> DataFrame:
    """Folds still to do: every fold (``all_folds``) left-anti the metrics."""
    keys = keys or ["fold"]
    if not has_partitions(spark, metrics_path):
        return all_folds
    done = spark.read.parquet(metrics_path).select(*keys).distinct()
    return all_folds.join(done, keys, "left_anti")


