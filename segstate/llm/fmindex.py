"""Benchmark decontamination with an FM-index per shard (operator 5).

Documents are read in shards of bounded size. Their words become symbols of
the benchmark's vocabulary; a word that no benchmark text has, and a run of
known words shorter than the shortest window, cannot be part of an occurrence
and becomes a separator. Over the rest a task builds an FM-index: suffix array
by prefix doubling, Burrows-Wheeler transform, and a wavelet matrix whose
levels answer rank queries in constant time. All windows of the benchmark are
searched backwards at once; their rows are located by walking to sampled suffix
positions, and overlapping occurrences are merged to removal spans.

The benchmark comes in blocks of at most ``BLOCK_WORDS`` words, which bounds
what is broadcast; each block is one pass over the documents that adds to the
spans found before it, so a benchmark of any size gives whole results.

A window is ``N`` consecutive words of an item; an item of fewer words, but
not none, is one window. Defined results: null texts have no words; items
without words match nothing; items with a null id are left out; rows that
share an item_id count as one item with the windows of all; every document row
gives one result row, repeated or not; a text longer than a shard is a shard of
its own; an empty benchmark or table gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.llm import textarrays as T
from segstate.llm.common import row_key, stored

N = 10
SHARD_SYMBOLS, SHARD_WORDS = 1 << 20, 1 << 22
BLOCK_WORDS = 1 << 20
SAMPLE = 16


# -- the index ---------------------------------------------------------------
def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; 0 is a separator, each unlike all others, so no
    comparison goes beyond the next one."""
    n = len(symbols)
    breaks = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(breaks)
    rank[breaks] = np.arange(len(breaks))
    order = np.argsort(rank, kind="stable")
    step = 0
    while True:
        key = rank if not step else rank * (n + 1) + np.append(rank[step:] + 1, np.zeros(min(step, n), np.int64))[:n]
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank = new
        if not n or rank[order[-1]] == n - 1:
            return order
        step = step * 2 or 1


class WaveletMatrix:
    """Rank queries on a sequence of small numbers, vectorised over queries."""

    def __init__(self, values: np.ndarray, limit: int):
        self.bits = max(1, int(limit).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value stands before each place."""
        low = np.zeros(len(value), dtype=np.int64)
        at = at.astype(np.int64)
        for i, ones in enumerate(self.ones):
            bit = ((value >> (self.bits - 1 - i)) & 1).astype(bool)
            a, b = ones[at], ones[low]
            at = np.where(bit, self.zeros[i] + a, at - a)
            low = np.where(bit, self.zeros[i] + b, low - b)
        return at - low


class FMIndex:
    """FM-index of symbols 1..limit with separators 0."""

    def __init__(self, symbols: np.ndarray, limit: int):
        suffixes = suffix_array(symbols)
        before = symbols[suffixes - 1]
        before[suffixes == 0] = 0
        self.last = before
        self.tree = WaveletMatrix(before, limit)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=limit + 1))])
        # a walk never crosses a separator: run starts are sampled too
        marked = (suffixes % SAMPLE == 0) | (before == 0)
        self.marks = marked
        self.samples = suffixes[marked]
        self.before_mark = np.cumsum(marked) - marked

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern (padded at the end)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), len(self.last), dtype=np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > j) & (low < high))
            c = patterns[live, j]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows, by walking back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.marks[at]
            out[todo[hit]] = self.samples[self.before_mark[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.last[at]
            at = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out


# -- the benchmark -----------------------------------------------------------
class Phrases:
    """Windows of a block of benchmark items as symbols."""

    def __init__(self, items: list[tuple[int, str]]):
        ids = np.array([i for i, _ in items], dtype=np.int64)
        words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for block in T.blocks(pa.array([t for _, t in items], pa.string())):
            w = T.Words(block, T.ALNUM, True)
            words.append(w.hash)
            counts.append(w.counts)
        words, counts = np.concatenate(words), np.concatenate(counts)
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        codes = codes.astype(np.int64) + 1
        offsets = np.concatenate([[0], np.cumsum(counts)])
        wins = np.where(counts > 0, np.maximum(counts - N + 1, 1), 0)
        at, length = T.ragged(offsets[:-1], wins), np.minimum(np.repeat(counts, wins), N)
        table = np.zeros((len(at), N), dtype=np.int64)
        for j in range(N):
            live = length > j
            table[live, j] = codes[at[live] + j]
        owner = np.repeat(ids, wins)
        self.windows, which = (np.unique(table, axis=0, return_inverse=True) if len(table)
                               else (table, np.zeros(0, np.int64)))
        which = which.reshape(-1)
        self.lengths = (self.windows > 0).sum(axis=1)
        order = np.argsort(which, kind="stable")
        self.owner = owner[order]
        self.owner_at = np.searchsorted(which[order], np.arange(len(self.windows) + 1))
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 1
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1.. for words of the vocabulary, else 0."""
        out = np.zeros(len(hashes), dtype=np.int64)
        some = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[some])
        at = np.minimum(at, len(self.vocabulary) - 1)
        ok = self.vocabulary[at] == hashes[some] if len(self.vocabulary) else np.zeros(0, bool)
        out[some[ok]] = at[ok] + 1
        return out

    def find(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of all occurrences in a shard."""
        if not len(symbols) or not len(self.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = FMIndex(symbols, len(self.vocabulary))
        low, high = index.search(self.windows, self.lengths)
        return index.locate(T.ragged(low, high - low)), np.repeat(np.arange(len(low)), high - low)


def blocks_of(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """(block, whether it is the last) of at most ``BLOCK_WORDS`` words each (or
    one item); one block at a time is in memory."""
    held, size = [], 0
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    for item, text in rows.toLocalIterator():
        words = len(text) // 2 + 1
        if held and size + words > BLOCK_WORDS:
            yield held, False
            held, size = [], 0
        held.append((item, text))
        size += words
    yield held, True


# -- the shards --------------------------------------------------------------
SPAN = "array<struct<start:long,end:long>>"
SCHEMA = f"doc_id long, rk long, n_words long, spans {SPAN}, items array<long>"


class Shard:
    """Documents whose words are searched together."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.rows, self.counts, self.kept, self.at = [], [], [], []
        self.words = self.n = 0

    def add(self, rows: pa.RecordBatch, w: T.Words) -> None:
        s = self.phrases.symbols(w.hash)
        # runs of known words inside a document, at least one window long
        known = s > 0
        head = known.copy()
        head[1:] &= ~known[:-1]
        starts_doc = np.zeros(len(s) + 1, dtype=bool)
        starts_doc[w.offsets] = True
        head |= known & starts_doc[:-1]
        start = np.flatnonzero(head)
        stop = np.append(start[1:], len(s))
        gap = np.append(np.flatnonzero(~known), len(s))
        stop = np.minimum(stop, gap[np.searchsorted(gap, start)])
        long = stop - start >= self.phrases.shortest
        start, size = start[long], (stop - start)[long]
        inside = T.ragged(start, size)
        cuts = np.cumsum(size)
        self.kept.append(np.insert(s[inside], cuts, 0))
        self.at.append(np.insert(inside + self.words, cuts, -1))
        self.rows.append(rows)
        self.counts.append(w.counts)
        self.words += len(s)
        self.n += len(self.kept[-1])

    def full(self) -> bool:
        return self.n >= SHARD_SYMBOLS or self.words >= SHARD_WORDS

    def results(self) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate(self.counts)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        at, window = self.phrases.find(np.concatenate(self.kept))
        first = np.concatenate(self.at)[at]
        doc = np.searchsorted(offsets, first, "right") - 1
        change = np.zeros(self.words + 1, dtype=np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + self.phrases.lengths[window], -1)
        cover = (np.cumsum(change) > 0).astype(np.int8)
        # spans end at their document: a window never crosses it
        edge = np.diff(cover, prepend=0, append=0)
        cut = offsets[1:-1][(cover[offsets[1:-1] - 1] > 0) & (cover[offsets[1:-1]] > 0)] if len(offsets) > 2 else []
        start = np.sort(np.concatenate([np.flatnonzero(edge > 0), cut]).astype(np.int64))
        end = np.sort(np.concatenate([np.flatnonzero(edge < 0), cut]).astype(np.int64))
        span_doc = np.searchsorted(offsets, start, "right") - 1
        found_spans: dict[int, list] = {}
        for d, a, b in zip(span_doc, start - offsets[span_doc], end - offsets[span_doc], strict=True):
            found_spans.setdefault(int(d), []).append((int(a), int(b)))
        found_items: dict[int, set] = {}
        pairs = np.unique(np.stack([doc, window], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
        for d, x in pairs:
            found_items.setdefault(int(d), set()).update(
                self.phrases.owner[self.phrases.owner_at[x]:self.phrases.owner_at[x + 1]].tolist())
        done = 0
        for rows in self.rows:
            spans, items = [], []
            for i in range(rows.num_rows):
                spans.append(merge((rows.column("spans")[i].as_py() or []), found_spans.get(done + i, ())))
                items.append(sorted({*(rows.column("items")[i].as_py() or []), *found_items.get(done + i, ())}))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("rk"), *([rows.column("text")] if "text" in rows.schema.names else []),
                 pa.array(counts[done:done + rows.num_rows], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(items, pa.list_(pa.int64()))],
                names=["doc_id", "rk", *(["text"] if "text" in rows.schema.names else []), "n_words", "spans", "items"])
            done += rows.num_rows


def merge(old: list[dict], new) -> list[dict]:
    """Overlapping or touching spans as one."""
    out: list[dict] = []
    for a, b in sorted([(s["start"], s["end"]) for s in old] + list(new)):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _searcher(block, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value)
        shard = Shard(phrases)
        for batch in batches:
            for b in T.blocks(batch.column("text")):
                rows = batch.slice(b.first, b.n)
                if not keep_text:
                    rows = rows.drop_columns(["text"])
                shard.add(rows, T.Words(b, T.ALNUM, True))
                if shard.full():
                    yield from shard.results()
                    shard = Shard(phrases)
        if shard.rows:
            yield from shard.results()
    return run


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, rk, n_words, spans, items) of every document; spans are word ranges
    that occurrences of benchmark windows cover, merged."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", row_key().alias("rk"), "text", F.lit(None).cast(SPAN).alias("spans"),
                       F.lit(None).cast("array<long>").alias("items"))
    for part, last in blocks_of(benchmark):
        schema = SCHEMA if last else SCHEMA.replace("n_words", "text string, n_words")
        rows = rows.mapInArrow(_searcher(sc.broadcast(part), not last), schema)
        if not last:
            rows = stored(rows, "hits").drop("n_words")
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of ``occurrences``: a row per document."""
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return (occurrences(docs, benchmark)
            .select("doc_id", "n_words", length.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "spans", "rk")
            .withColumn("contaminated", F.col("n_hit") > 0))
