"""Quality rules by distribution divergence (operator 2).

One pass over the texts counts the base rules and two histograms per document:
character classes and common words, the latter with one bin for all other
words. Their sums per language over the whole corpus are the references. A
document goes if a base rule fails or if the Jensen-Shannon distance (square
root of the divergence in bits) between one of its histograms and the reference
of its language is above the limit of the language. Limits are the upper
quartile of the distances of the language plus ``FENCE`` quartile ranges, and
at least a fixed floor. Word distances fall with the square root of the length
by chance alone, so their quartiles are those of distance times that root and
the limit of a document is divided by it. The minimum length counts the words
or characters of the document, whichever they are.

Defined results: null and empty texts have no words and fail the base rule;
a null or unknown language has a reference of its own; equal rows get equal
results, one row each; very long texts are one block of a task. A language
without a document long enough has no reference and rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstate.llm import textarrays as T
from segstate.llm.common import row_key, stored

# Function words of the languages that the references describe.
COMMON_WORDS = (
    "the of and to in a is that for it with as was on by be this are from or an at not"
    " der die das und ist von zu den mit auf ein im nicht des für sich dem eine als auch"
    " de la le et les en un du que qui est une dans pour au par pas sur avec"
    " el los las y por con una su para se del lo como más al o"
).split()

MIN_CHARS, MIN_WORDS = 200, 50
# Floors of the limits, in the gap of the distances measured on sf0.01 and
# check_s: below 0.24 for texts of each language, above 0.28 (words) and 0.33
# (characters) for texts without its words or full of symbols.
CHAR_FLOOR, WORD_FLOOR, FENCE = 0.25, 0.25, 2
MAX_SCALED = 20.0

CLASSES = ("lower", "upper", "wide", "digit", "space", "line", "mark", "symbol")
_CLASS = np.full(256, 7, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[192:256], _CLASS[48:58] = 0, 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 6
_CLASS[128:192] = 8  # later bytes of a code point
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "[#*$%&|<>]" if c not in "[]"]] = True

SCHEMA = ("doc_id long, rk long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
          " n_repeat_words long, n_chars long, n_plain long, chars array<long>, words array<long>")


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    column = pa.array(sorted(set(COMMON_WORDS)))
    block = next(T.blocks(column))
    h = T.range_hash(block, block.offsets[:-1], block.offsets[1:], True)
    order = np.argsort(h)
    return h[order], order


def _repeat_words(w: T.Words) -> np.ndarray:
    """Words of each text covered by 3-word windows found twice or more in it."""
    sh, at, wins = T.shingles(w.hash, w.offsets, 3, False)
    at = at[T.repeated(sh, np.repeat(np.arange(len(wins)), wins))]
    cover = np.zeros(len(w.hash) + 3, dtype=bool)
    for j in range(3):
        cover[at + j] = True
    return T.group_sum(cover[:len(w.hash)].astype(np.int64), w.counts)


def _dup_lines(block: T.Block, w: T.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([block.offsets[1:], breaks]), kind="stable")
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    first = T.first_of(T.range_hash(block, starts, ends, False), doc)
    return np.bincount(doc[~first], minlength=block.n)


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common, slot = _common_hashes()
    bins = len(slot) + 1
    for batch in batches:
        for block in T.blocks(batch.column("text")):
            w = T.Words(block, T.NOT_SPACE, False)
            d, doc = block.data, np.repeat(np.arange(block.n), np.diff(block.offsets))
            lead = ((d & 0xC0) != 0x80)
            solid = (lead & T.NOT_SPACE[d]).astype(np.int64)
            size = np.diff(block.offsets)
            hist = np.bincount(doc * 9 + _CLASS[d], minlength=block.n * 9).reshape(-1, 9)[:, :8]
            plain = T.Words(block, T.ALNUM, True)
            at = np.minimum(np.searchsorted(common, plain.hash), len(common) - 1)
            kind = np.where(common[at] == plain.hash, slot[at], bins - 1) if len(at) else at
            words = np.bincount(plain.doc() * bins + kind, minlength=block.n * bins).reshape(-1, bins)
            rows = slice(block.first, block.first + block.n)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id")[rows], batch.column("rk")[rows], batch.column("lang")[rows], pa.array(w.counts),
                pa.array(T.group_sum(solid, size)), pa.array(T.group_sum(_SYMBOL[d].astype(np.int64), size)),
                pa.array(_dup_lines(block, w).astype(np.int64)), pa.array(_repeat_words(w)),
                pa.array(hist.sum(axis=1)), pa.array(words.sum(axis=1)), _lists(hist), _lists(words)],
                names=["doc_id", "rk", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "n_chars", "n_plain", "chars", "words"])


def _lists(table: np.ndarray) -> pa.ListArray:
    n, k = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(table.ravel().astype(np.int64)))


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance (0 to 1) of two distributions."""
    def term(p, q):
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    parts = F.zip_with(a, b, lambda p, q: (term(p, q) + term(q, p)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v), F.lit(0.0)))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda v: v / F.nullif(total, F.lit(0)))


def references(stats: DataFrame) -> DataFrame:
    """(ref_lang, ref_chars, ref_words): distributions of each language."""
    n_words = len(set(COMMON_WORDS)) + 1
    sums = stats.groupBy("lang").agg(
        F.sum("n_chars").alias("n_chars"), F.sum("n_plain").alias("n_plain"),
        *[F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))],
        *[F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(n_words)])
    return sums.select(
        F.col("lang").alias("ref_lang"),
        _shares(F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))]), F.col("n_chars")).alias("ref_chars"),
        _shares(F.array(*[F.col(f"w{i}") for i in range(n_words)]), F.col("n_plain")).alias("ref_words"))


def limits(measured: DataFrame) -> DataFrame:
    """(limit_lang, char_limit, word_scale): upper fences of each language over
    the documents that pass the base rules. The rounded values are few, so the
    exact quartiles need bounded memory."""
    good = measured.where(~F.col("base_failed"))
    scaled = F.least(F.col("word_distance") * F.sqrt("n_plain"), F.lit(MAX_SCALED))
    quartiles = good.groupBy("lang").agg(
        F.percentile(F.round("char_distance", 3), F.array(F.lit(0.25), F.lit(0.75))).alias("c"),
        F.percentile(F.round(scaled, 2), F.array(F.lit(0.25), F.lit(0.75))).alias("w"))

    def fence(q):
        return F.col(q)[1] + FENCE * (F.col(q)[1] - F.col(q)[0])

    return quartiles.select(F.col("lang").alias("limit_lang"), F.greatest(fence("c"), F.lit(CHAR_FLOOR)).alias("char_limit"),
                            fence("w").alias("word_scale"))


def quality(docs: DataFrame) -> DataFrame:
    """Base counts, both distances (null below the minimum length) and the
    verdict of every document."""
    stats = stored(docs.select("doc_id", row_key().alias("rk"), F.col("lang").cast("string").alias("lang"), "text")
                   .mapInArrow(measure, SCHEMA), "quality")
    both = stats.join(references(stats), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    char_js = F.when(F.col("n_chars") >= MIN_CHARS, js_distance(_shares(F.col("chars"), F.col("n_chars")), F.col("ref_chars")))
    word_js = F.when(F.col("n_plain") >= MIN_WORDS, js_distance(_shares(F.col("words"), F.col("n_plain")), F.col("ref_words")))
    measured = stored(both.withColumn("base_failed", failed)
                      .withColumn("char_distance", F.round(char_js, 6)).withColumn("word_distance", F.round(word_js, 6))
                      .drop("chars", "words", "ref_lang", "ref_chars", "ref_words"), "distances")
    word_limit = F.greatest(F.col("word_scale") / F.sqrt(F.greatest("n_plain", F.lit(1))), F.lit(WORD_FLOOR))
    far = (F.col("char_distance") > F.col("char_limit")) | (F.col("word_distance") > word_limit)
    return (measured.join(limits(measured), F.col("lang").eqNullSafe(F.col("limit_lang")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    "kept", "char_distance", "word_distance", "rk"))
