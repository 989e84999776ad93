"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination and
BPE encoding, each stage over all documents that its predecessor kept.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and
returns a DataFrame; the caller writes it as Parquet and rereads it as the next
one's ``docs``. All but the last return the columns of ``documents``.

Defined results, for every stage: a null text is the empty text and stays null in
the rows that are kept; empty and word-free texts fail the quality rules, and a
later stage that meets them keeps them; very long texts are read whole; rows that
share a doc_id are told apart by their text, and rows that share both get one
verdict, but near dedup leaves one of them, the first by its other columns written
as JSON; ties in a group of near-duplicates go to the smallest doc_id, a null one
last; an empty table gives an empty table; columns of other names and types, maps
included, pass through and clash with nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segstate.llm import bpe, fmindex, lines, neardup, quality
from segstate.llm.catalog import vocabulary_path
from segstate.llm.common import stored, table
from segstate.session import new_work_dir


def _row_key(docs: str) -> Column:
    """``row_key`` of the rows of an aliased table."""
    return F.xxhash64(F.col(f"{docs}.doc_id"), F.col(f"{docs}.text"))


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined with rows (doc_id, rk). The aliases keep the
    columns of the two apart, whatever their names."""
    same = (_row_key("docs_of_stage").eqNullSafe(F.col("keys_of_stage.rk"))
            & F.col("docs_of_stage.doc_id").eqNullSafe(F.col("keys_of_stage.doc_id")))
    return docs.alias("docs_of_stage").join(keys.select("doc_id", "rk").alias("keys_of_stage"), same, how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _matching(docs, quality.quality(docs).where("kept"), "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand in many; ``n_chars`` follows."""
    out = lines.apply_bitmaps(docs, lines.dedup_lines(docs))
    text = F.when(F.col("doc.text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    found = neardup.near_duplicates(docs)
    kept = stored(found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("rk") == F.col("component_rk")))
                  .groupBy("doc_id", "rk").agg(F.count("*").alias("k")), "kept")
    once = _matching(docs, kept.where("k = 1"), "left_semi")
    again = kept.where("k > 1")
    if again.isEmpty():
        return once
    # rows equal in doc_id and text: the limit on the rank prunes them in every task
    rows = _matching(docs, again, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.doc_id", "row.text").alias("rk"), F.to_json("row").alias("json"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "rk").orderBy("json"))).where("nth = 1")
    return once.unionByName(first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    hits = fmindex.occurrences(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0)
    return _matching(docs, stored(hits.select("doc_id", "rk"), "contaminated"), "left_anti")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_digest(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe encoding", bpe_encoding),
]

#: No SQL expresses the last stage; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = os.path.join(new_work_dir(spark, "pipeline"), f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
