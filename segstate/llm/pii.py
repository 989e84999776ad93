"""Personal data by bootstrapped contextual extraction (operator 3).

The base patterns (email, ip, card, phone) give the seeds: each whole base
span, overlapping ones taken together, is a trusted occurrence. Every other
token with a digit or ``@`` that is long enough to identify something, and any
token with a fixed secret prefix, is an occurrence as well. Lexical patterns
are the word before, the word after and the written prefix (a name up to ``=`` or
``:``, with or without spaces and quotes around the sign); the words stand alone,
for identifiers of any form, and with the coarse form of the occurrence (has ``@``,
has a digit, neither). Spark keeps the graph of patterns and instances
(lower-cased occurrences): in each round a pattern scores the share of its
instances that are trusted, patterns of high score and enough trusted instances
are promoted, and instances that a promoted pattern holds become trusted with its
score. Rounds go on until nothing changes. Occurrences that a promoted pattern
holds and that no base span touches are returned as spans of kind ``id``. Fixed
prefixes that name a secret are patterns from the start.

Defined results: null is the empty text; each row gives one row, repeated or
not; rows that share a doc_id are told apart by an id written with the first
pass; ties in score are all promoted; without seeds only the fixed prefixes
promote anything; very long texts are read in time that grows with their length,
and words of over ``LONGEST`` characters stand for themselves by a digest; an empty
table gives no rows; columns of any other name are never read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstate.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
MIN_SCORE, MIN_SUPPORT, MIN_TOKEN = 0.8, 3, 6
DIGITS = 4  # of scores, so that the rounds come to an end
LONGEST = 256

# Written prefixes that announce a secret.
SECRET_PREFIXES = ("password=", "passwd=", "pwd=", "token=", "secret=", "api_key=", "apikey=", "key=",
                   "password:", "token:", "secret:")

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, and takes whole runs.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@=:]*+[0-9@=:]\S*+")
_NOT_DIGIT = re.compile("[^0-9]+")
_PREFIX = re.compile(r"[A-Za-z_]+[=:]")
_WORD = re.compile(r"\S+")
_QUOTES = "\"'`"
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
# a secret's name, the sign and a value that stands apart
_SECRET = re.compile(r"(?<![A-Za-z_])(?:" + "|".join(sorted({p[:-1] for p in SECRET_PREFIXES}, key=len, reverse=True))
                     + r")\s*[=:]\s+[\"'`]?(\S+)|(?<![A-Za-z_])(?:" + "|".join(sorted({p[:-1] for p in SECRET_PREFIXES}, key=len, reverse=True))
                     + r")\s+[=:]\s*[\"'`]?(\S+)", re.IGNORECASE)
_EDGE = " \t\n\r.,;:!?\"'`()[]{}<>|#$%&*~^"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of the email pattern, leftmost first: from each ``@`` back over
    the local part and on over the domain, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        # a failed local part is not read again
        end = max(end, at + 1)
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        # int() of a long run of digits is slow, so its length is looked at first
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                if all(len(p := g.lstrip("0")) < 4 and int(p or "0") <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                    if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def form(token: str) -> str:
    """The coarse form of an occurrence."""
    return "@" if "@" in token else "9" if _DIGIT.search(token) else "a"


def whole(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges of the base spans, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, _, b in base:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _key(word: str) -> str:
    """A word as a node of the graph."""
    return word if len(word) <= LONGEST else "sha256 " + hashlib.sha256(word.encode()).hexdigest()


def written_prefix(text: str, start: int) -> str:
    """The name and the sign before a place, over spaces and quotes: ``token=``
    for ``token = "``; empty without one."""
    i = start
    while i and text[i - 1] in _QUOTES:
        i -= 1
    while i and text[i - 1] in " \t":
        i -= 1
    if not i or text[i - 1] not in "=:":
        return ""
    sign = text[i - 1]
    i -= 1
    while i and text[i - 1] in " \t":
        i -= 1
    end = i
    while i and text[i - 1] in _LETTERS:
        i -= 1
    return _key(text[i:end].lower()) + sign if i < end else ""


class _Words:
    """The words of a text by place, found when they are first needed."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def around(self, start: int, end: int) -> tuple[str, str]:
        """The words before and after the word or words that a range touches."""
        if self.starts is None:
            spans = [m.span() for m in _WORD.finditer(self.text)]
            self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        i = bisect.bisect_right(self.ends, start) - 1
        j = bisect.bisect_left(self.starts, end)
        return (self.text[self.starts[i]:self.ends[i]] if i >= 0 else "",
                self.text[self.starts[j]:self.ends[j]] if j < len(self.starts) else "")


def _occurrence(text: str, words: _Words, start: int, end: int, seed: bool) -> dict:
    """The range with the patterns around it."""
    token = text[start:end]
    patterns = []
    for kind, word in zip("LR", words.around(start, end), strict=True):
        if word:
            word = _key(word.lower())
            patterns += [f"{kind}:{word}", f"{kind}:{word}|{form(token)}"]
    glued = None if seed else _PREFIX.match(token)
    prefix = _key(glued[0].lower()) if glued else written_prefix(text, start)
    if prefix:
        patterns.append(f"P:{prefix}")
    return {"start": start, "end": end, "instance": _key(token.lower()), "patterns": patterns, "seed": seed}


def _candidates(text: str) -> list[tuple[int, int]]:
    """Ranges of the tokens that may identify something, in order."""
    found = {}
    for m in _TOKEN.finditer(text):
        token = m[0].strip(_EDGE)
        prefix = _PREFIX.match(token)
        secret = prefix and prefix[0].lower() in SECRET_PREFIXES and prefix.end() < len(token)
        if secret or (len(token) >= MIN_TOKEN and form(token) != "a"):
            start = m.start() + m[0].index(token)
            found[start] = start + len(token)
    for m in _SECRET.finditer(text):
        group = 1 if m[1] else 2
        token = m[group].strip(_EDGE)
        if token:
            start = m.start(group) + m[group].index(token)
            found[start] = start + len(token)
    return sorted(found.items())


def token_occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Whole base spans and identifier-like tokens with their patterns."""
    spans, words = whole(base), _Words(text)
    out = [_occurrence(text, words, a, b, True) for a, b in spans]
    at = 0
    for start, end in _candidates(text):
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if at == len(spans) or end <= spans[at][0]:
            out.append(_occurrence(text, words, start, end, False))
    return out


FOUND = ("doc_id long, rid long, base array<struct<start:long,kind:int,end:long>>,"
         " tokens array<struct<start:long,end:long,instance:string,patterns:array<string>,seed:boolean>>")
_BASE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_TOKENS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()),
                              ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, tokens = [], []
        for x in batch.column("text"):
            text = x.as_py() or ""
            b = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in b])
            tokens.append(token_occurrences(text, b))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(base, _BASE),
                                          pa.array(tokens, _TOKENS)], names=["doc_id", "rid", "base", "tokens"])


def promoted_patterns(edges: DataFrame, min_score: float = MIN_SCORE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(pattern, score) when nothing changes any more. ``edges``: pattern,
    instance, seed. Scores only grow and have ``DIGITS`` digits, so it ends."""
    edges = stored(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    trust = stored(edges.where("seed").select("instance", F.lit(1.0).alias("trust")).distinct(), "trust")
    fixed = F.substring("pattern", 3, 1 << 20).isin(*SECRET_PREFIXES) & F.col("pattern").startswith("P:")
    before = None
    while True:
        scored = edges.join(trust, "instance", "left").groupBy("pattern").agg(
            F.round(F.sum(F.coalesce("trust", F.lit(0.0))) / F.count("*"), DIGITS).alias("score"),
            F.count(F.when(F.col("trust") >= min_score, 1)).alias("support"))
        patterns = stored(scored.where(fixed | ((F.col("score") >= min_score) & (F.col("support") >= min_support)))
                          .select("pattern", F.when(fixed, 1.0).otherwise(F.col("score")).alias("score")), "patterns")
        # the sum of whole numbers does not depend on the order of the rows
        state = patterns.agg(F.count("*"), F.sum(F.round(F.col("score") * 10**DIGITS).cast("long"))).first()
        if state == before:
            return patterns
        before = state
        held = edges.join(patterns, "pattern").groupBy("instance").agg(F.max("score").alias("trust"))
        trust = stored(trust.unionByName(held).groupBy("instance").agg(F.max("trust").alias("trust")), "trust")


def personal_data(docs: DataFrame) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    found = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text").mapInArrow(_find, FOUND), "pii")
    tokens = found.where(F.size("tokens") > 0).select("rid", F.explode("tokens").alias("t")).select("rid", "t.*")
    edges = tokens.select(F.explode("patterns").alias("pattern"), "instance", "seed")
    good = promoted_patterns(edges)
    extra = (tokens.where(~F.col("seed")).select("rid", "start", "end", F.explode("patterns").alias("pattern"))
             .join(good, "pattern").select("rid", "start", "end").distinct()
             .groupBy("rid").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("more")))
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    more = F.coalesce("more", F.array().cast("array<struct<start:long,kind:int,end:long>>"))
    return found.drop("tokens").join(extra, "rid", "left").select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_id"),
        ((F.size("base") > 0) | (F.size(more) > 0)).alias("has_personal_data"))
