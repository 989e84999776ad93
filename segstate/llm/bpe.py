"""BPE encoding and decoding by speculation and verification (operator 9).

For the distinct words of a batch a greedy longest match proposes tokens. A
proposal is right exactly if each of its tokens encodes to itself and each pair
of neighbours is compatible, that is, the merges of the joined text of the two
give the two tokens back. Pairs are tested by exact merging and then looked up;
the test of all neighbours of a batch is one vectorised lookup in a table. Only
words with a failing pair undergo exact merging, all those of a batch at a time.

The vocabulary file (word-level BPE with an end-of-word mark, ids of about
50,000 tokens, so bounded) is a parameter and is read in the tasks.

Defined results: null is the empty text, which has no tokens and decodes to the
empty text; the strings of special tokens inside a text become their ids;
unused truncation and padding; equal rows get equal results; an empty table gives
no rows; columns of any other name are never read. What a task remembers (results
of words, verdicts on pairs) is bounded by ``MEMO_BYTES`` and
``PAIR_SLOTS`` and is dropped at its end; a forgotten word is worked out again.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from segstate.llm.common import texts

MEMO_BYTES = 48 << 20  # for words, which cost some 300 bytes each
PAIR_SLOTS = 1 << 18
END = "</w>"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, ids array<int>"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte:
    visible Latin-1 letters stand for themselves, the others follow from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in visible:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


class Table:
    """Numbers by code, open-addressed, looked up many at a time."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(3 * len(codes)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.zeros(1 << self.bits, dtype=np.int32)
        at = self.slot(codes)
        while len(codes):
            # one of the codes that want a free place gets it, the others go on
            free = self.key[at] < 0
            self.key[at[free]], self.value[at[free]] = codes[free], values[free]
            left = self.key[at] != codes
            codes, values, at = codes[left], values[left], (at[left] + 1) % len(self.key)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray, default: int) -> np.ndarray:
        slot = self.slot(codes)
        key = self.key[slot]
        out = np.where(key == codes, self.value[slot], default)
        at = np.flatnonzero((key != codes) & (key >= 0))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) % len(self.key)
            key = self.key[slot]
            hit = key == codes[at]
            out[at[hit]] = self.value[slot[hit]]
            go = ~hit & (key >= 0)
            at, slot = at[go], slot[go]
        return out


class Merges:
    """Exact merging by rank, the leftmost of equals first, of many words at a time.

    Words of one width stand in a matrix of token ids with links to the next and
    the previous live place; each step merges the best pair of every word that
    still has one. Pairs are looked up in an open-addressed table."""

    WIDEST = 64
    NONE = np.int32(2**31 - 1)

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]]):
        self.ids, self.rank = ids, {m: i for i, m in enumerate(merges)}
        self.into = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        codes = np.array([ids[a] << 20 | ids[b] for a, b in merges], dtype=np.int64)
        self.pairs = Table(codes, np.arange(len(codes), dtype=np.int32))
        letters = [t for t in ids if len(t.removesuffix(END)) == 1 and t != END]
        top = max((ord(t[0]) for t in letters), default=0)
        self.plain, self.ending = np.full(top + 2, -1, dtype=np.int64), np.full(top + 2, -1, dtype=np.int64)
        for t in letters:
            (self.ending if t.endswith(END) else self.plain)[ord(t[0])] = ids[t]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; ``NONE`` if it does not merge."""
        # a place without a letter gives a code that no pair has
        return self.pairs.find(np.where((left < 0) | (right < 0), 1 << 62, left << 20 | right), self.NONE)

    def many(self, words: list[str], ends: np.ndarray) -> list[list[int]]:
        """Ids of each word; ``ends`` tells whether its last letter ends a word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        width = np.left_shift(1, np.ceil(np.log2(np.maximum(size, 4))).astype(np.int64))
        for w in np.unique(width).tolist():
            group = np.flatnonzero(width == w)
            if w > self.WIDEST:
                for i in group.tolist():
                    out[i] = self.long(words[i], bool(ends[i]))
                continue
            for lo in range(0, len(group), 65536):
                part = group[lo:lo + 65536]
                for i, found in zip(part.tolist(), self.matrix([words[i] for i in part.tolist()], size[part], ends[part], w), strict=True):
                    out[i] = found
        return out

    def matrix(self, words: list[str], size: np.ndarray, ends: np.ndarray, width: int) -> list[list[int]]:
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        codes = np.minimum(codes, len(self.plain) - 1)  # the last place is no letter
        inside = np.arange(width) < size[:, None]
        sym = np.full((n, width), -1, dtype=np.int64)
        sym[inside] = self.plain[codes]
        last = np.flatnonzero(ends & (size > 0))
        final = np.cumsum(size)[last] - 1
        sym[last, size[last] - 1] = self.ending[codes[final]]
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        after[after >= size[:, None]] = width
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        rank = np.full((n, width), self.NONE, dtype=np.int32)
        rank[:, :-1] = self.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
        rank[~inside] = self.NONE
        live = np.arange(n)
        while len(live):
            best = rank[live]
            i = best.argmin(axis=1)
            r = best[np.arange(len(live)), i]
            more = r < self.NONE
            live, i, r = live[more], i[more], r[more]
            j = after[live, i]
            k = after[live, j]
            sym[live, i], sym[live, j] = self.into[r], -1
            rank[live, j] = self.NONE
            after[live, i] = k
            rest = k < width
            before[live[rest], k[rest]] = i[rest]
            rank[live, i] = np.where(rest, self.ranks(sym[live, i], sym[live, np.minimum(k, width - 1)]), self.NONE)
            h = before[live, i]
            has = h >= 0
            rank[live[has], h[has]] = self.ranks(sym[live[has], h[has]], sym[live[has], i[has]])
        used = sym >= 0
        flat, stop = sym[used].tolist(), np.cumsum(used.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    def long(self, word: str, ends: bool) -> list[int]:
        """One long word, its pairs in a heap by rank and place."""
        sym = list(word)
        if ends:
            sym[-1] += END
        n, rank = len(sym), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if sym[i] is not None else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue  # one of the two was merged since
            sym[i], sym[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (p := (sym[x], sym[y])) in rank:
                    heapq.heappush(heap, (rank[p], x, *p))
        return [self.ids[t] for t in sym if t in self.ids]


class Tokens:
    """Greedy longest match of many words at a time, in a trie of the tokens whose
    steps (node, letter) are looked up in an open-addressed table."""

    def __init__(self, ids: dict[str, int]):
        step: dict[int, int] = {}
        plain, ending = [-1], [-1]
        for token, i in ids.items():
            node = 0
            for c in token.removesuffix(END):
                code = node << 12 | ord(c)
                node = step.setdefault(code, len(plain))
                if node == len(plain):
                    plain.append(-1)
                    ending.append(-1)
            (ending if token.endswith(END) else plain)[node] = i
        self.plain, self.ending = np.array(plain), np.array(ending)
        self.steps = Table(np.fromiter(step, np.int64, len(step)), np.fromiter(step.values(), np.int32, len(step)))

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each has; none if a place of the
        word starts no token."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        letters = np.append(np.minimum(letters, 4095), 4095)
        end = np.cumsum(size)
        at = end - size
        node, token, after = np.zeros(len(words), np.int64), np.full(len(words), -1), at.copy()
        live, failed, found = np.flatnonzero(size > 0), [], []
        while len(live):
            to = self.steps.find(node[live] << 12 | letters[at[live]], -1)
            to[at[live] >= end[live]] = -1
            on = live[to >= 0]
            node[on] = to[to >= 0]
            at[on] += 1
            here = np.where(at[on] == end[on], self.ending[node[on]], self.plain[node[on]])
            token[on[here >= 0]], after[on[here >= 0]] = here[here >= 0], at[on[here >= 0]]
            done = live[to < 0]
            failed.append(done[token[done] < 0])
            done = done[token[done] >= 0]
            found.append((done, token[done]))
            at[done], node[done], token[done] = after[done], 0, -1
            done = done[at[done] < end[done]]
            live = np.concatenate([on, done])
        owner, flat = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        owner, flat = owner[order], flat[order]
        if failed:
            good = ~np.isin(owner, np.concatenate(failed))
            owner, flat = owner[good], flat[good]
        return flat, np.bincount(owner, minlength=len(words))


class Recent:
    """Results of words, bounded by bytes. When full, only the words of the last
    use stay, which are the ones that come again."""

    def __init__(self, limit: int):
        self.limit, self.size, self.kept = limit, 0, {}

    def take(self, words: Iterable[str], work_out: Callable[[list[str]], Iterable[tuple]]) -> dict[str, tuple]:
        """A table with the results of all words, those that are not kept worked
        out."""
        kept = self.kept
        missing = [w for w in words if w not in kept]
        made = dict(zip(missing, work_out(missing), strict=True)) if missing else {}
        self.size += self.bytes(made)
        if self.size <= self.limit:
            kept.update(made)
            return kept
        now = {w: kept[w] for w in words if w in kept} | made
        self.kept, self.size = now, self.bytes(now)
        if self.size > self.limit:
            self.forget()
        return now

    @staticmethod
    def bytes(results: dict[str, tuple]) -> int:
        """An estimate: a letter has an id of six digits at most, and a token."""
        return 250 * len(results) + 9 * sum(map(len, results))

    def forget(self) -> None:
        self.kept, self.size = {}, 0


class Vocabulary:
    """Tokens, ranks of merges and special strings of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.merges = Merges(self.ids, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        # the same for ASCII texts; the classes stand inside brackets
        self.split_ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r"))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letter = dict(enumerate(byte_letters()))
        self.text = {i: str(i) for i in self.token}
        self.marks = {s: (str(i), 1, s) for s, i in self.special.items()}
        self.tokens = Tokens(self.ids)
        self.words = Recent(MEMO_BYTES)
        self.forget()

    def forget(self) -> None:
        """Drops what was remembered; the vocabulary stays."""
        self.words.forget()
        self.pair = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.good = np.zeros(PAIR_SLOTS, dtype=bool)

    # -- speculation ---------------------------------------------------------
    def compatible(self, pairs: list[int]) -> list[bool]:
        """Whether the text of the two tokens of each pair encodes to them; the
        right one is 0 for a token on its own, else its id and 1."""
        tokens = [[p >> 20, (p & 0xFFFFF) - 1] if p & 0xFFFFF else [p >> 20] for p in pairs]
        words = ["".join([self.token[t].removesuffix(END) for t in ts]) for ts in tokens]
        ends = np.fromiter((self.token[ts[-1]].endswith(END) for ts in tokens), bool, len(tokens))
        return [found == ts for found, ts in zip(self.merges.many(words, ends), tokens, strict=True)]

    def verify(self, pairs: np.ndarray) -> np.ndarray:
        """Compatibility of each pair (coded as one number). Verdicts are kept in a
        table of fixed size, where a new pair takes the place of another."""
        slot = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64) % PAIR_SLOTS
        ok = self.good[slot]
        miss = np.flatnonzero(self.pair[slot] != pairs)
        if len(miss):
            new, first, back = np.unique(pairs[miss], return_index=True, return_inverse=True)
            verdict = np.array(self.compatible(new.tolist()), dtype=bool)
            ok[miss] = verdict[back]
            at = slot[miss[first]]
            self.pair[at], self.good[at] = new, verdict
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words given in byte letters."""
        flat, count = self.tokens.propose(words)
        ok = count > 0
        owner = np.repeat(np.arange(len(words)), count)
        ok[owner[~self.verify(flat << 20)]] = False
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ok[owner[inner[~self.verify((flat[inner] << 20) | (flat[inner + 1] + 1))]]] = False
        stop, tokens = np.cumsum(count).tolist(), flat.tolist()
        out = [tokens[a:b] for a, b in zip([0, *stop], stop, strict=False)]
        failed = np.flatnonzero(~ok).tolist()
        for i, ids in zip(failed, self.merges.many([words[i] for i in failed], np.ones(len(failed), dtype=bool)), strict=True):
            out[i] = ids
        return out

    # -- texts ---------------------------------------------------------------
    def normal(self, text: str) -> str:
        """NFC, then lower case code point by code point; the capital sigma is
        the only one that ``lower`` treats by its place in the word."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def results(self, words: list[str]) -> list[tuple[str, int, str]]:
        """(ids as text, number of ids, tokens as text) of each word."""
        text, token, letter = self.text, self.token, self.letter
        letters = [w if w.isascii() and w.isalnum() else w.encode("utf-8").decode("latin-1").translate(letter) for w in words]
        return [(" ".join([text[i] for i in ids]), len(ids), " ".join([token[i] for i in ids])) for ids in self.encode_words(letters)]

    def pieces(self, text: str) -> list[str]:
        """Words of the normal text and special strings, in order."""
        out = []
        for part in self.special_split.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(part)
            else:
                part = self.normal(part)
                out += (self.split_ascii if part.isascii() else self.split).findall(part)
        return out

    def encode_batch(self, batch: list[str]) -> list[list[tuple[str, int, str]]]:
        """Per text the (ids as text, number of ids, tokens as text) of each of
        its words."""
        split = [self.pieces(t) for t in batch]
        seen = set()
        for p in split:
            seen.update(p)
        of = self.words.take(seen.difference(self.special), self.results)
        if not seen.isdisjoint(self.special):
            of = {**of, **self.marks}
        return [[of[w] for w in p] for p in split]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, as a file without a decoder has it;
        ids outside the vocabulary are left out."""
        return " ".join([self.token[i] for i in ids if i in self.token])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _slices(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Slices of a column of about ``size`` characters; null is empty."""
    lo, held, total = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_py() or ""
        held.append(t)
        total += len(t)
        if total >= size:
            yield lo, held
            lo, held, total = i + 1, [], 0
    if held:
        yield lo, held


def _runner(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        v.forget()
        # no cycles are made here, and the collector would walk the vocabulary
        gc.disable()
        try:
            yield from encoded(v, batches)
        finally:
            gc.enable()
            v.forget()

    def encoded(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, held in _slices(batch.column("text")):
                ids = batch.column("doc_id")[lo:lo + len(held)]
                found = v.encode_batch(held)
                if digest:
                    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
                    parts = [zip(*d, strict=True) if d else ((), (), ()) for d in found]
                    rows = [(sum(n), sha(" ".join(filter(None, ids))), sha(" ".join(filter(None, tokens)))) for ids, n, tokens in parts]
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, *cols],
                                                     names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    codes = [[int(t) for c in d if c[1] for t in c[0].split(" ")] for d in found]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(codes, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return texts(docs).mapInArrow(_runner(path, False), ENCODED)


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the text decoded from
    them, for every document."""
    return texts(docs).mapInArrow(_runner(path, True), SCHEMA)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = [v.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
