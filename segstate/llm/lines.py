"""Line deduplication with range-partitioned line hashes (operator 6, built-ins
only).

Every line becomes a 64-bit hash of its key (white space stripped at both
ends, A-Z lower-cased). The hashes are range-partitioned by (hash, document),
so a line that stands in a third of all documents spreads over many
partitions, and sorted by document and position inside them. One streaming
pass marks the first line of each (hash, document), which needs no further
exchange; a partial count per hash then gives the number of documents and the
first occurrence of each key. Documents get back a compressed bitmap of the
lines to drop, not text: pairs (word number, 64 bits), empty words left out.

Defined results: null and empty texts are one empty line; rows that share a
doc_id count as one document, and equal rows get equal bitmaps; null doc_id
is a document of its own; other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstate.llm.common import row_key, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\f\r"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column, ascii_only: Column) -> Column:
    """Stripped line with A-Z lower-cased; ``lower`` is the same on ASCII."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, hashes): a hash per line, null for keys of no code point."""
    ascii_only = F.length("text") == F.octet_length("text")
    hashes = F.transform(
        split_lines(F.col("text")),
        lambda x: F.when(F.btrim(x, F.lit(SPACE)) != "", F.xxhash64(line_key(x, F.coalesce(ascii_only, F.lit(True))))))
    return docs.select("doc_id", row_key().alias("rk"), hashes.alias("hashes"))


def occurrences(hashed: DataFrame) -> DataFrame:
    """(h, doc_id, rk, pos) of every line that has a key."""
    return (hashed.select("doc_id", "rk", F.posexplode("hashes").alias("pos", "h"))
            .where("h is not null"))


def key_counts(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h, first): keys found in at least ``min_docs`` documents and their first
    place (doc_id, rk, pos)."""
    per_doc = Window.partitionBy("h", "doc_id").orderBy("rk", "pos")
    firsts = (lines.repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id", "rk", "pos")
              .withColumn("nth", F.row_number().over(per_doc)).where("nth = 1"))
    return (firsts.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rk", "pos")).alias("first"))
            .where(F.col("n") >= min_docs).drop("n"))


def drop_bitmaps(lines: DataFrame, keys: DataFrame, keep_first: bool) -> DataFrame:
    """(doc_id, rk, bits): sparse 64-bit words of the lines that go."""
    hit = lines.join(keys, "h")
    if keep_first:
        hit = hit.where(~F.struct("doc_id", "rk", "pos").eqNullSafe(F.col("first")))
    word = F.floor(F.col("pos") / 64).cast("int")
    return (hit.select("doc_id", "rk", word.alias("w"), F.expr("shiftleft(1L, pos % 64)").alias("b"))
            .groupBy("doc_id", "rk", "w").agg(F.bit_or("b").alias("b"))
            .groupBy("doc_id", "rk").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("bits")))


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc_id, rk, bits) of the documents that lose a line, a row each.

    ``keep_first``: the first occurrence of a key stays, else all go."""
    hashed = stored(line_hashes(docs), "line_hashes")
    lines = occurrences(hashed)
    return drop_bitmaps(lines, key_counts(lines, min_docs), keep_first)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` text beside their
    own columns, which are held in the struct ``doc``."""
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.col("doc_id"), row_key().alias("rk"))
    right = bitmaps.select(F.col("doc_id").alias("b_id"), F.col("rk").alias("b_rk"), "bits")
    out = left.join(right, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("rk") == F.col("b_rk")), "left")
    lines = split_lines(F.col("doc.text"))
    gone = F.expr("filter(lines, (x, i) -> (coalesce(try_element_at(bits, cast(i div 64 as int)), 0L) & shiftleft(1L, i % 64)) = 0)")
    out = out.select("doc", "bits", lines.alias("lines"))
    kept = F.when(F.col("bits").isNull(), F.col("lines")).otherwise(gone)
    return (out.select("doc", F.size("lines").cast("long").alias("n_lines"), kept.alias("left_lines"))
            .select("doc", "n_lines", (F.col("n_lines") - F.size("left_lines")).alias("n_dropped"),
                    F.array_join("left_lines", "\n").alias("kept")))
