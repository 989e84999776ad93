"""Substring deduplication by paragraph MinHash banding (operator 1).

Texts are cut into fragments where the hash of the next four words is the
smallest within ``REACH`` words on either side, so the cuts follow the content:
a passage copied into the middle of another text, or wrapped at other places,
is cut at the same places. Beside the fragments stand the written paragraphs
of ``MIN_PASSAGE`` words or more, for copies with changed words: they end at
empty lines and around lines of ``LONG_LINE`` words or more; shorter lines are
joined. Units of both kinds are 5-word shingle sets, salted by the kind, so a
fragment never meets the paragraph it stands in. Equal ones form a class; each class gives
``BANDS`` MinHash values as one-row bands, tuned for recall: a pair at the
threshold of 0.75 shares none with a chance of 0.25 ** BANDS, 1.6 %. Classes
that share a band are verified by their exact Jaccard similarity and joined to
components. A unit is repeated if its component has two members or more;
repeated units that touch or overlap are one passage, and passages of
``MIN_PASSAGE`` words or more are returned. Of each component the first
unit by (doc_id, position) stays, the others are to be removed.

Most units are alone in all their bands. The bands go through one exchange as
(band, class) and only shared ones come out of it; units whose class neither
occurs twice nor shares a band are dropped before anything else is joined.

Defined results: null, empty and very short texts have no units and no
rows; fewer than ``MIN_PARAGRAPH`` words before the first cut of a text are no
fragment; a passage repeated inside one document counts; rows that share a doc_id
are told apart by their text, and equal rows are each other's copies; a null
doc_id comes first in the order; documents without repeated passages have no
rows; very long texts are cut to units block by block; an empty table gives no
rows; columns of any other name are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstate.llm import textarrays as T
from segstate.llm.common import row_key, stored
from segstate.llm.similarity import link, pruned_components

K, PERCENT = 5, 75
REACH, BANDS = 6, 3
MIN_PARAGRAPH, MIN_PASSAGE, LONG_LINE = 6, 14, 25
FRAGMENT, WRITTEN = 0, 1

UNITS = "doc_id long, rk long, rid long, kind int, start int, n_words int, cid long"
BANDED = "h long, cid long"
_TOP = np.uint64(2**64 - 1)


def written(block: T.Block, w: T.Words) -> np.ndarray:
    """First words of the written paragraphs of a block with words."""
    n = len(w.hash)
    line = np.cumsum(block.data == 10)[w.starts]
    text = np.zeros(n, dtype=bool)
    text[w.offsets[:-1][w.counts > 0]] = True
    fresh = text.copy()
    fresh[1:] |= line[1:] != line[:-1]
    first = np.flatnonzero(fresh)
    long = np.diff(np.append(first, n)) >= LONG_LINE
    cut = text[first]
    cut[1:] |= (line[first[1:]] - line[first[:-1]] > 1) | long[1:] | long[:-1]
    return first[cut]


def paragraphs(block: T.Block) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and first word, length and kind of each unit of a block."""
    w = T.Words(block, T.NOT_SPACE, True)
    n = len(w.hash)
    if not n:
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.zeros(n, dtype=bool)
    head[w.offsets[:-1][w.counts > 0]] = True
    segment = np.cumsum(head)
    v = np.full(n, _TOP)
    if n > 3:
        h = np.zeros(n - 3, dtype=np.uint64)
        for j in range(4):
            h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[j:n - 3 + j])
        v[:n - 3] = np.where(segment[3:] == segment[:n - 3], h, _TOP)
    lowest = v < _TOP
    for j in range(1, REACH + 1):
        if j >= n:
            break
        same = segment[j:] == segment[:-j]
        lowest[:-j] &= ~same | (v[:-j] <= v[j:])
        lowest[j:] &= ~same | (v[j:] < v[:-j])
    units = []
    for kind, starts, least in ((FRAGMENT, np.flatnonzero(head | lowest), MIN_PARAGRAPH), (WRITTEN, written(block, w), MIN_PASSAGE)):
        sizes = np.diff(np.append(starts, n))
        some = sizes >= least
        units.append((starts[some], sizes[some], np.full(int(some.sum()), kind)))
    return w, *(np.concatenate(x) for x in zip(*units, strict=True))


def _unit_shingles(w: T.Words, starts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wins = sizes - K + 1
    at = T.ragged(starts, wins)
    h = np.repeat(kinds * 1000 + K, wins).astype(np.uint64)
    for j in range(K):
        h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + j])
    return h, wins


def _classes(sh: np.ndarray, wins: np.ndarray) -> np.ndarray:
    """Class of each unit: the order of the words counts, it is a sequence."""
    at = np.cumsum(wins) - wins
    order = (np.arange(len(sh)) - np.repeat(at, wins)).astype(np.uint64)
    return T.mix(T.group_sum(T.mix(sh + order * np.uint64(0xD1B54A32D192ED03)), wins) + wins.astype(np.uint64))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            w, starts, sizes, kinds = paragraphs(block)
            if not len(starts):
                continue
            doc = np.searchsorted(w.offsets, starts, "right") - 1
            rows = pa.array(block.first + doc)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(rows), batch.column("rk").take(rows), batch.column("rid").take(rows),
                pa.array(kinds.astype(np.int32)), pa.array((starts - w.offsets[doc]).astype(np.int32)),
                pa.array(sizes.astype(np.int32)), pa.array(T.signed(_classes(*_unit_shingles(w, starts, sizes, kinds))))],
                names=["doc_id", "rk", "rid", "kind", "start", "n_words", "cid"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, cid) of each class, once for a block of texts."""
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            w, starts, sizes, kinds = paragraphs(block)
            if not len(starts):
                continue
            sh, wins = _unit_shingles(w, starts, sizes, kinds)
            cid, first = np.unique(_classes(sh, wins), return_index=True)
            at = np.cumsum(wins) - wins
            for b in range(BANDS):
                low = T.mix(np.minimum.reduceat(T.seeded(sh, 50 + b), at)[first] + np.uint64(b))
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(low)), pa.array(T.signed(cid))], names=["h", "cid"])


def shared_bands(docs: DataFrame) -> DataFrame:
    """(h, cid, k): the members of the bands of two classes or more."""
    band = Window.partitionBy("h")
    rows = (docs.select("text").mapInArrow(_bands, BANDED)
            .withColumn("low", F.min("cid").over(band)).withColumn("top", F.max("cid").over(band)).where("low < top"))
    rows = stored(rows.select("h", "cid").distinct(), "bands")
    return rows.join(rows.groupBy("h").agg(F.count("*").alias("k")), "h")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, set): shingles of the wanted units of each text."""
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            w = T.Words(block, T.NOT_SPACE, True)
            want = batch.column("want")[block.first:block.first + block.n].to_pylist()
            flat = [(x["cid"], w.offsets[d] + x["start"], x["n_words"], x["kind"]) for d, xs in enumerate(want) for x in xs]
            if not flat:
                continue
            cid, starts, sizes, kinds = (np.array(c, dtype=np.int64) for c in zip(*flat, strict=True))
            sets, n = T.distinct(*_unit_shingles(w, starts, sizes, kinds))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid), pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(T.signed(sets)))],
                names=["cid", "set"])


def similar(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two sets, at least PERCENT."""
    both = F.size(F.array_intersect(a, b))
    return (100 + PERCENT) * both >= PERCENT * (F.size(a) + F.size(b))


def repeated_passages(docs: DataFrame, min_words: int = MIN_PASSAGE) -> DataFrame:
    """(doc_id, start, end, component, first_doc_id, n_removed): passages, as
    ranges of words, that repeat elsewhere. ``component`` is that of the first
    unit, ``first_doc_id`` where its kept copy stands, ``n_removed`` the
    words of the passage that go."""
    units = stored(docs.select("doc_id", row_key().alias("rk"), F.monotonically_increasing_id().alias("rid"), "text")
                   .mapInArrow(_units, UNITS), "paragraphs")
    bands = shared_bands(docs)
    near = bands.select("cid").distinct()
    twice = units.groupBy("cid").agg(F.count("*").alias("k")).where("k > 1").select("cid")
    slim = units.select("rid", "kind", "start", "n_words", "cid")
    live = stored(slim.join(near.unionByName(twice).distinct(), "cid"), "live")
    rows = stored(units.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("rk").alias("rk")), "rows")
    reps = (live.join(near, "cid").groupBy("cid").agg(F.min(F.struct("rid", "start", "n_words", "kind")).alias("r"))
            .select("cid", "r.*").join(rows.select("rid", "rk"), "rid"))
    reps = stored(reps, "reps")
    shared = stored(bands.join(reps.select("cid", (F.col("n_words") - K + 1).alias("n")), "cid"), "buckets")
    wanted = reps.groupBy("rk").agg(F.collect_list(F.struct("cid", "start", "n_words", "kind")).alias("want"))
    sets = stored(docs.select(row_key().alias("rk"), "text").join(wanted, "rk").dropDuplicates(["rk"])
                  .select("text", "want").mapInArrow(_contents, "cid long, set array<long>"), "contents")

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
        b = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
        return pairs.join(a, "a").join(b, "b").where(similar(F.col("sa"), F.col("sb"))).select("a", "b")

    labels = link(shared, verify, PERCENT, lambda wanted: sets.join(wanted, "cid"),
                  group=pruned_components)
    whole = live.join(labels, F.col("cid") == F.col("node"), "left").join(rows.drop("rk"), "rid").select(
        "doc_id", "rid", "kind", "start", "n_words", F.coalesce("comp", "cid").alias("comp"))
    whole = stored(whole, "labelled")
    firsts = (whole.groupBy("comp").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "rid", "start")).alias("first"))
              .where("k > 1").drop("k"))
    end = F.col("start") + F.col("n_words")
    removed = ~F.struct("doc_id", "rid", "start").eqNullSafe(F.col("first"))
    again = whole.join(firsts, "comp").withColumn("end", end).withColumn("gone", F.when(removed, F.col("end")))
    in_order = Window.partitionBy("rid").orderBy("start", "kind")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    # words of a unit that no earlier unit covers or removes
    seen = (again.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
            .withColumn("n_gone", F.when(F.col("gone").isNotNull(), F.greatest(
                F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("gone").over(before), F.lit(0)))))))
    runs = (seen.withColumn("run", F.sum("fresh").over(in_order))
            .groupBy("doc_id", "rid", "run").agg(
                F.min("start").alias("start"), F.max("end").alias("end"),
                F.min_by("comp", F.struct("start", "kind")).alias("component"),
                F.min_by("first.doc_id", F.struct("start", "kind")).alias("first_doc_id"),
                F.coalesce(F.sum("n_gone"), F.lit(0)).alias("n_removed")))
    return runs.where(F.col("end") - F.col("start") >= min_words).select(
        "doc_id", "start", "end", "component", "first_doc_id", "n_removed")
