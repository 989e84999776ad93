"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstate.session import ensure_checkpoint_dir, materialize


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    ensure_checkpoint_dir(df.sparkSession)
    return materialize(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, so that columns of any other name
    in the input cannot clash with its own."""
    return docs.select("doc_id", *more, "text")


def row_key() -> F.Column:
    """Tells rows that share a doc_id apart by their text."""
    return F.xxhash64("doc_id", "text")
