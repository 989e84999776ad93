"""Row ids, fold assignment and the train / validation splits.

Row numbers inside a class are computed without a single-task window:
the rows are range-partitioned on (class, order key) and sorted inside each
partition, so the partitions hold consecutive runs of the order. A tiny table
of per-(partition, class) counts (partitions x classes rows) gives every
partition its starting offset, and row number = offset + local position. The
range-partitioned keys are stored first so that the count pass and the
numbering pass see identical partitions even after a lost executor.

Sequence tables have one row per block of a sequence (``sources.blocks``); their
numbers and folds are worked out on slim keys, one per sequence, and joined back
on the row id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstate.functions.hashing import hash_key
from segstate.session import materialize


def ordered_row_number(df: DataFrame, group: str, order: list[str], out: str = "row_id",
                       partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by *order)`` (1-based),
    distributed over range partitions. ``order`` must be a total order
    inside each group."""
    # without an explicit count AQE may coalesce the range partitions
    ranged = materialize(df.repartitionByRange(*([partitions] if partitions else []), group, *order)
                         .sortWithinPartitions(group, *order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    counts = ranged.groupBy("_pid", group).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", group, "_first",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # offsets has at most partitions x groups rows: a bounded broadcast
    numbered = ranged.join(F.broadcast(offsets), on=["_pid", group])
    return (numbered.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
            .drop("_pid", "_mid", "_first", "_off"))


def sequence_keys(seqs: DataFrame) -> DataFrame:
    """(rid, workitem, cls), one row per sequence of a sequence table."""
    return seqs.where(F.col("t0") == 0).select("rid", "workitem", "cls")


def row_ids(keys: DataFrame) -> DataFrame:
    """``row_id`` in ``workitem`` order inside each class; ids that repeat
    are told apart by the row id."""
    return ordered_row_number(keys, "cls", [c for c in ("workitem", "rid") if c in keys.columns], "row_id")


def folded_sequences(seqs: DataFrame, k: int, seed: int, with_row_ids: bool = False) -> DataFrame:
    """A sequence table with ``kfold`` (K1) and, when asked, ``row_id``."""
    keys = sequence_keys(seqs)
    numbered = assign_folds(row_ids(keys) if with_row_ids else keys, k, seed)
    return seqs.join(numbered.drop("workitem", "cls"), "rid")


def fold_order_key(seed: int):
    """Salted apart from the hash of ``hash_sample``: a sample keeps one end of
    that hash, and the buckets of the fold order must stay evenly filled."""
    return F.md5(hash_key(F.lit(seed), F.lit("fold"), F.col("workitem")))


def hashed_row_number(df: DataFrame, group: str, hex_key: str, tie: str, out: str,
                      digits: int = 4) -> DataFrame:
    """``row_number() over (partition by group order by hex_key, tie)`` for a
    uniformly distributed hex key (an md5 digest).

    The first ``digits`` hex digits cut the order into 16^digits buckets that
    are ranges of the order and hold about the same number of rows, even when
    one group holds most rows. Bucket sizes give each bucket its offset (a
    table of groups x buckets rows, broadcast); inside a bucket the window is
    partitioned by (group, bucket). Deterministic: no sampling, no ids that
    depend on task order, so a recomputed task gives the same numbers."""
    bucket = F.conv(F.substring(F.col(hex_key), 1, digits), 16, 10).cast("int")
    keyed = df.withColumn("_bk", bucket)
    local = Window.partitionBy(group, "_bk").orderBy(hex_key, tie)
    numbered = keyed.withColumn("_loc", F.row_number().over(local))
    # bucket sizes: a two-phase count over the key columns only (the scan
    # below prunes every other column)
    sizes = keyed.groupBy(group, "_bk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # offsets has at most groups x 16^digits rows: a bounded broadcast
    return (numbered.join(F.broadcast(offsets), on=[group, "_bk"])
            .withColumn(out, (F.col("_off") + F.col("_loc")).cast("bigint"))
            .drop("_bk", "_loc", "_off"))


def assign_folds(seqs: DataFrame, k: int, seed: int) -> DataFrame:
    """K1: stratified, balanced folds. Rows of a class are put in a
    pseudo-random order by md5(seed:workitem) (ties broken by workitem) and
    dealt round-robin: ``kfold = (position - 1) mod k``. Fold sizes inside a
    class differ by at most one; no list of ids passes through the driver."""
    keyed = seqs.withColumn("_h", fold_order_key(seed))
    tie = "rid" if "rid" in seqs.columns else "workitem"
    numbered = hashed_row_number(keyed, "cls", "_h", tie, "_pos")
    return (numbered.withColumn("kfold", ((F.col("_pos") - 1) % F.lit(k)).cast("int"))
            .drop("_h", "_pos"))


def training_fanout(folded: DataFrame, k: int) -> DataFrame:
    """P4 for all folds at once: each sequence of fold f trains the models of
    every other fold of its class; one output row per (model fold, sequence)."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("kfold"))
    return folded.withColumn("fold", F.explode(others))


def validation_rows(folded: DataFrame) -> DataFrame:
    """P5: every sequence is validated once, in its own fold."""
    return folded.withColumn("fold", F.col("kfold"))


def class_counts(seqs: DataFrame) -> DataFrame:
    """P6."""
    return seqs.groupBy("cls").agg(F.count("*").alias("n"))
