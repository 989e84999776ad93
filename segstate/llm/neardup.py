"""Near-duplicate documents by fast similarity sketching (operator 7).

A document is the set of its distinct 5-word shingles. Sketching runs in
rounds: in each of the first T rounds a hash throws every shingle into one of T
bins with a random value, in round T + j all shingles go to bin j. A bin keeps
the smallest value of the first round that reaches it, so every bin is filled
after at most 2 T rounds and, for sets larger than T log T, mostly after one.
Equal coordinates estimate the Jaccard similarity with the concentration of
independent samples, at the cost of about one hash per shingle.

Documents with equal sets are one class from the start. The T coordinates form
bands; classes that share a band are compared by ``similarity.link`` on their
full sets (64-bit shingle hashes, recomputed from the whole texts). At the
threshold of 0.75 a linked pair shares no band with a chance of 2e-5.

Defined results: null, empty and word-free texts have size 0 and are linked
with nothing; texts of fewer than 5 words are one shingle; each row gives one
result row, repeated rows included; a null doc_id is linked by its text, and
the component takes the smallest doc_id that is not null; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.llm import textarrays as T
from segstate.llm.common import row_key, stored
from segstate.llm.similarity import link, shared_buckets

K, PERCENT = 5, 75
BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS

SCHEMA = "doc_id long, rk long, n long, cid long, bands array<long>"


def fast_similarity_sketch(values: np.ndarray, counts: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Sketches (sets x t) of a ragged array of distinct 64-bit values."""
    full = np.uint64(2**64 - 1)
    out = np.full(len(counts) * t, full, dtype=np.uint64)
    group = np.repeat(np.arange(len(counts)), counts)
    for i in range(2 * t):
        h = T.seeded(values, 1000 + i)
        place = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        # the round, then the value: an earlier round always wins
        value = (np.uint64(i) << np.uint64(54)) | (T.seeded(h, 7) >> np.uint64(10))
        np.minimum.at(out, group * t + place, value)
        empty = (out.reshape(-1, t) == full).any(axis=1) & (counts > 0)
        if not empty.any():
            break
        live = empty[group]
        if not live.all():
            values, group = values[live], group[live]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    cells = sketch.reshape(len(sketch), bands, rows)
    for j in range(rows):
        key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
    return key


def shingle_sets(block: T.Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, with counts."""
    w = T.Words(block, T.NOT_SPACE, True)
    sh, _, wins = T.shingles(w.hash, w.offsets, K, True)
    return T.distinct(sh, wins)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            sets, n = shingle_sets(block)
            cid = T.mix(T.group_sum(T.seeded(sets, 3), n) + T.mix(n.astype(np.uint64)))
            keys = band_keys(fast_similarity_sketch(sets, n))
            bands = pa.ListArray.from_arrays(np.arange(block.n + 1, dtype=np.int32) * BANDS, pa.array(T.signed(keys.ravel())))
            rows = slice(block.first, block.first + block.n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[rows], batch.column("rk")[rows], pa.array(n),
                 pa.array(T.signed(cid), mask=n == 0), bands], names=["doc_id", "rk", "n", "cid", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, set): the shingles of each text."""
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            sets, n = shingle_sets(block)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid")[block.first:block.first + block.n],
                 pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(T.signed(sets)))],
                names=["cid", "set"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, ta, tb) whose texts are similar enough."""
    for batch in batches:
        size = np.array([len(x) + len(y) for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(),
                                                         strict=True)], dtype=np.int64)
        for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // T.BLOCK_BYTES)) + 1):
            if not len(part):
                continue
            rows = batch.slice(int(part[0]), len(part))
            a, na = shingle_sets(next(T.blocks(rows.column("ta"), 1 << 60)))
            b, nb = shingle_sets(next(T.blocks(rows.column("tb"), 1 << 60)))
            both = np.concatenate([a, b])
            owner = np.concatenate([np.repeat(np.arange(len(part)), na), np.repeat(np.arange(len(part)), nb)])
            union = np.bincount(owner[T.first_of(both, owner)], minlength=len(part))
            ok = pa.array(100 * (na + nb - union) >= PERCENT * union)
            yield pa.RecordBatch.from_arrays([rows.column("a").filter(ok), rows.column("b").filter(ok)], names=["a", "b"])


def sketches(docs: DataFrame) -> DataFrame:
    return stored(docs.select("doc_id", row_key().alias("rk"), "text").mapInArrow(_sketch, SCHEMA), "sketches")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, rk, n_shingles, component_id, component_rk) of every row of
    ``docs``; the last two are the document that stays."""
    sk = sketches(docs)
    classes = sk.where("cid is not null").groupBy("cid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("first"), F.min("rk").alias("rk"), F.min("n").alias("n"), F.any_value("bands").alias("bands"))
    shared = shared_buckets(classes.select("cid", "n", F.explode("bands").alias("h")))
    wanted = shared.select("cid").distinct().join(classes.select("cid", "rk"), "cid")
    content = stored(docs.select(row_key().alias("rk"), "text").join(wanted, "rk")
                     .select("cid", "text").dropDuplicates(["cid"]), "contents")

    def verify(pairs: DataFrame) -> DataFrame:
        a = content.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
        b = content.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_compare, "a long, b long")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return content.join(wanted, "cid").select("cid", "text").mapInArrow(_sets, "cid long, set array<long>")

    labels = link(shared, verify, PERCENT, sets_of)
    named = classes.select("cid", "first").join(labels, F.col("cid") == F.col("node"), "left").select(
        "cid", "first", F.coalesce("comp", "cid").alias("comp"))
    named = stored(named, "classes")
    firsts = named.groupBy("comp").agg(F.min(F.struct(F.col("first.doc_id").isNull().alias("none"), "first")).alias("m"))
    ids = named.join(firsts, "comp").select("cid", F.col("m.first.doc_id").alias("component_id"),
                                            F.col("m.first.rk").alias("component_rk"))
    return (sk.drop("bands").join(ids, "cid", "left")
            .select("doc_id", "rk", F.col("n").alias("n_shingles"),
                    F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.coalesce("component_rk", "rk").alias("component_rk")))
