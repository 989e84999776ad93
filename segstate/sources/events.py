"""The fixture sequence tables D1 and D2 of FIXTURES.md, built from the event
table in blocks (S1b, ``sources.blocks``), and the hash sample (P1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segstate.functions.hashing import hash_key, md5_uniform
from segstate.functions.obs import symbol_index
from segstate.sources.blocks import BLOCK, event_blocks

# The event alphabets of the fixtures (FIXTURES.md section 3).
# D1 uses every event type in alphabetical order (K = 5).
USER_ALPHABET = ["click", "error", "purchase", "signup", "view"]
# D2 labels a bucket with the error type and observes the remaining types (K = 4).
LABEL_EVENT = "error"
LABELLED_ALPHABET = ["click", "purchase", "signup", "view"]
BUCKET_ORIGIN = "2024-01-01"
BUCKET_DAYS = 3


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def user_sequences(spark: SparkSession, sf_dir: str, block: int = BLOCK) -> DataFrame:
    """Fixture D1: one sequence per user over all event types (K = 5)."""
    return event_blocks(read_table(spark, sf_dir, "events"), F.col("user_id"),
                        symbol_index(F.col("event_type"), USER_ALPHABET), block=block)


def bucket_of(ts: Column) -> Column:
    days = F.datediff(ts.cast("date"), F.lit(BUCKET_ORIGIN).cast("date"))
    return F.floor(days / F.lit(BUCKET_DAYS)).cast("bigint")


def _workitem() -> Column:
    return F.concat_ws("-", F.col("user_id").cast("string"), bucket_of(F.col("ts")).cast("string"))


def labelled_sequences(spark: SparkSession, sf_dir: str, block: int = BLOCK) -> DataFrame:
    """Fixture D2 (flagship input): one sequence per (user, 3-day bucket).

    ``cls`` is 1 when the bucket holds an error event; the error events are
    the label, the other types are the observations (K = 4). Buckets with no
    observation left are dropped."""
    return event_blocks(read_table(spark, sf_dir, "events"), _workitem(), symbol_index(F.col("event_type"), LABELLED_ALPHABET),
                        F.col("event_type") == F.lit(LABEL_EVENT), block=block)


def labelled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workitem, cls) of D2 from counts alone, for what needs no symbols."""
    lab = (F.col("event_type") == F.lit(LABEL_EVENT)).cast("int")
    return (read_table(spark, sf_dir, "events").select(_workitem().alias("workitem"), lab.alias("lab"))
            .groupBy("workitem").agg(F.max("lab").alias("cls"), F.min("lab").alias("only"))
            .where("only = 0").select("workitem", "cls"))


def hash_sample(df: DataFrame, fraction: float, seed: int, key: str = "workitem") -> DataFrame:
    """Bernoulli sample without replacement, decided per row by a hash
    of (seed, key): reproducible, no shuffle, same rows on recomputation."""
    if fraction >= 1.0:
        return df
    return df.where(md5_uniform(hash_key(F.lit(seed), F.col(key))) < F.lit(float(fraction)))
