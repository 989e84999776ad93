"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstate.llm import bpe, chat, fmindex, hosts, licenses, lines, merkle, neardup, paragraphs, pii, quality, repair, simhash
from segstate.llm.common import table
from segstate.llm.oracles import ORACLES  # noqa: F401


def vocabulary_path() -> str:
    """The public word-level vocabulary; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def q_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(table(spark, sf_dir, "documents"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("rk")


def q_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def q_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = hosts.labelled_outcomes(table(spark, sf_dir, "labels"))
    return hosts.judge(table(spark, sf_dir, "pages"), outcomes, hosts.page_document(F.col("url"))).drop("lower")


def q_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "rk")


def q_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (lines.apply_bitmaps(docs, lines.dedup_lines(docs))
            .select("doc.doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"),
                    F.sha2(F.col("kept"), 256).alias("kept_sha256")))


def q_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("rk", "component_rk")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def q_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_paths(chat.chosen_paths(chat.chains(told.unionByName(chat.injected(spark)))))
    return chat.read_back(formatted).drop("leaf").withColumnRenamed("tree", "conv_id")


def q_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), vocabulary_path())


def q_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def q_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves, tops, nodes = merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_text())
    return merkle.multiproofs(leaves, tops, nodes)


def q_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(told), told)


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


QUERIES = {
    "op1_paragraph_dedup": q_paragraphs,
    "op2_quality_divergence": q_quality,
    "op3_bootstrapped_pii": q_pii,
    "op4_host_reputation": q_hosts,
    "op5_fm_index": q_fmindex,
    "op6_line_dedup": q_lines,
    "op7_near_duplicates": q_neardup,
    "op8_reply_trees": q_chat,
    "op9_bpe": q_bpe,
    "op10_license_scan": q_licenses,
    "op11_merkle_manifest": q_merkle,
    "op12_structure_repair": q_repair,
    "op13_simhash": q_simhash,
}
