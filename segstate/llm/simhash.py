"""Near-duplicates by SimHash fingerprints within Hamming distance 2 (operator 13).

A bit of the 64-bit fingerprint is 1 if it is set in over half of the hashes of
the 3-word shingles of a text, repeats included.

*Embedding.* A fingerprint is cut into 16 segments of 4 bits and mapped to the
vector of their bit counts. Flipping one bit moves one count by one, so the
Manhattan distance of two vectors is a lower bound of the Hamming distance.

*Grid range-join.* On the grid of count vectors two points at distance 2 or less
always have a grid point at distance 1 or less from both. Each fingerprint is
sent to its own cell and the up to 32 neighbouring ones, and the cells that two
fingerprints reach are the candidates of the range join.

*Exact verification.* In a shared cell a fingerprint stands for the bit strings
with that count vector at Hamming distance 1 or less, at most four of them. Two
fingerprints differ in two bits or less exactly if they have such a bit string
in common, so the members of a cell are grouped by it and tied to the least
one. No pair of a cell is ever enumerated: a group of thousands of copies costs
as many rows as it has members.

Defined results: null, empty and word-free texts have fingerprint zero and are
linked like any other; fewer than three words are one shingle; each row gives
one result row, repeated rows included; a null doc_id is linked by its text,
and the component takes the smallest doc_id that is not null; a bit set in
exactly half of the hashes is 0; very long texts are read in pieces; an empty
table gives no rows; columns of any other name are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstate.llm.common import stored, texts
from segstate.llm.similarity import components

K, SEED = 3, 42
SEGMENT, SEGMENTS, SPAN = 4, 16, 3  # bits of a segment, segments, bits of a count in the cell key
PIECE_BYTES = 1 << 20
SCHEMA = "doc_id long, fp long"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BREAK = re.compile(rb"[ \t-\r]")
_SHIFTS = np.arange(64, dtype=np.uint64)


def _pieces(data: memoryview) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    lo = 0
    while lo < len(data):
        hi = min(lo + PIECE_BYTES, len(data))
        if hi < len(data):
            found = _BREAK.search(data, hi)
            hi = found.start() if found else len(data)
        yield bytes(data[lo:hi])
        lo = hi


def _bit_counts(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of the shingles."""
    n = max(1, len(words) - K + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    get = xxhash.xxh64_intdigest
    hashes = np.fromiter((get(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(K, len(words)) - 1:].tolist(), strict=True)),
                         dtype=np.uint64, count=n)
    total = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 8192):
        total += ((hashes[lo:lo + 8192, None] >> _SHIFTS) & np.uint64(1)).sum(axis=0).astype(np.int64)
    return total, n


def fingerprint(data: memoryview) -> int:
    total, n, carry = np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces(data):
        words = carry + piece.translate(_LOWER).split()
        if len(words) >= K:
            more, k = _bit_counts(words)
            total, n = total + more, n + k
        carry = words[-(K - 1):]
    if not n and carry:
        total, n = _bit_counts(carry)
    return sum(1 << b for b in np.flatnonzero(2 * total > n).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text").cast(pa.large_binary())
        fps = [fingerprint(memoryview(b"" if not x.is_valid else x.as_buffer())) for x in column]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                                         names=["doc_id", "fp"])


def cell() -> Column:
    """Key of the vector of bit counts: three bits for each segment."""
    key = F.lit(0).cast("long")
    for j in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned("fp", SEGMENT * j).bitwiseAND(F.lit(2**SEGMENT - 1))).cast("long")
        key = key.bitwiseOR(F.shiftleft(count, SPAN * j))
    return key


def _flips() -> Column:
    """(cell, x) of a fingerprint and of the 64 bit strings one bit away, where
    ``cell`` is that of the bit string x."""
    here = F.struct(F.col("own").alias("cell"), F.col("fp").alias("x"))
    one = F.lit(1).cast("long")

    def flip(b: Column) -> Column:
        bit = F.call_function("shiftleft", one, b)
        step = F.call_function("shiftleft", one, (F.lit(SPAN) * F.floor(b / F.lit(SEGMENT))).cast("int"))
        moved = F.when(F.col("fp").bitwiseAND(bit) == 0, F.col("own") + step).otherwise(F.col("own") - step)
        return F.struct(moved.alias("cell"), F.col("fp").bitwiseXOR(bit).alias("x"))
    return F.concat(F.array(here), F.transform(F.sequence(F.lit(0), F.lit(63)), flip))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (fp) within distance 2;
    every fingerprint occurs in as many rows as it has shared bit strings."""
    points = fps.select("fp", cell().alias("own"))
    flips = points.select("fp", F.explode(_flips()).alias("m"))
    reached = points.select("fp", F.explode(F.array_distinct(F.transform(_flips(), lambda m: m["cell"]))).alias("cell"))
    shared = reached.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("top")).where("low < top").select("cell")
    candidates = stored(flips.select("fp", "m.cell", "m.x").join(stored(shared, "cells"), "cell").select("fp", "x"), "candidates")
    least = candidates.groupBy("x").agg(F.min("fp").alias("low"), F.max("fp").alias("top")).where("low < top").select("x", "low")
    return candidates.join(least, "x").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = stored(texts(docs).mapInArrow(_fingerprints, SCHEMA), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    labels = components(links(classes.select("fp")))
    named = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_digits() -> Column:
    return F.lower(F.lpad(F.hex("fp"), 16, "0"))
