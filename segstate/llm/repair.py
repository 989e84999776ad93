"""Conversation structure repair by dynamic programming over a grammar
(operator 12).

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. Per
row the edits are Keep (0), Rerole to user or assistant (2) and Delete (3, the
only one for blank and duplicate rows); empty turns of user or assistant may be
Inserted anywhere (2); a truncated row that stays costs 1.

*Symbols.* For its edits a row is one of nine symbols: its role initial (s, u, a
or other) in small letters, in capitals if truncated, and X if it must go.
Rows are put in order by range partitioning, and a conversation is cut into
segments of at most ``BLOCK`` rows, so a conversation that holds most rows
spreads over many tasks. Equal segments are worked on once.

*Grammar.* Re-Pair in rounds: Spark counts the neighbouring symbols of all
distinct segments, the most frequent pairs become rules, every segment is
rewritten. Rules are shared by all conversations. ``RULES`` bounds their number;
what no rule covers is multiplied symbol by symbol, so the bound loses nothing.

*DP.* A symbol is a 4 x 4 min-plus matrix over the states of the automaton
(nothing yet, after s, after u, after a). An entry is the least cost and the
ASCII-least audit string of that cost. Entries of equal cost are never prefixes
of each other (they differ in an edit of a row before their inserts differ), so
the order survives concatenation and the product is associative. Audits are
ropes: the entry of a rule refers to the entries of its two sides. Rules are
evaluated bottom-up once, segments are products of rules, conversations are
products of segments. A last streaming pass over the sorted rows applies the
audit and hashes the result turn by turn in bounded memory; it reads a
conversation in one task, as the digest of its text is sequential.

Defined results: null role and null text are one space (so blank), a null
conv_id is a conversation, null turns come first; rows that share a turn stand
in the order of role and text; equal rows are duplicates of each other; an empty
role has no initial, is illegal beside any other and cannot be kept; a
conversation without rows has zeros, an empty audit and the digest of the empty
text; very long texts are hashed in the JVM and only the last pass moves them;
an empty table gives no rows; columns of any other name are never read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstate.llm.common import stored

SPACE = " \t\n\x0b\f\r"
BLOCK_BITS = 12
RULES, RULES_A_ROUND = 1024, 128
SYMBOLS = "XsuaoSUAO"
PAIRS = "a int, b int, k long"
REPAIRED = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string, repaired_sha256 string")

# ------------------------------------------------------------ min-plus algebra

#: automaton: (state, role initial) -> state; accepted are 0 and 3
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

Rope = tuple  # (length, text) or (length, left, right)
Matrix = list  # 4 x 4 of None or (cost, rope)
EMPTY: Rope = (0, "")


def leaf(text: str) -> Rope:
    return (len(text), text)


def join(x: Rope, y: Rope) -> Rope:
    return x if not y[0] else y if not x[0] else (x[0] + y[0], x, y)


def flat(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if len(r) == 2:
            out.append(r[1])
        else:
            todo += (r[2], r[1])
    return "".join(out)


def less(x: Rope, y: Rope) -> bool:
    """Whether x is before y in ASCII order; parts that both share are skipped."""
    a, b = [x], [y]
    while a and b:
        p, q = a.pop(), b.pop()
        if p is q:
            continue
        if len(p) == len(q) == 2:
            n = min(p[0], q[0])
            if p[1][:n] != q[1][:n]:
                return p[1][:n] < q[1][:n]
            if p[0] > n:
                a.append(leaf(p[1][n:]))
            if q[0] > n:
                b.append(leaf(q[1][n:]))
            continue
        # the longer side is opened, so that shared parts meet as wholes
        open_p, open_q = len(p) == 3 and (p[0] >= q[0] or len(q) == 2), len(q) == 3 and (q[0] >= p[0] or len(p) == 2)
        a += (p[2], p[1]) if open_p else (p,)
        b += (q[2], q[1]) if open_q else (q,)
    return bool(b)


def better(x, y):
    """The one of two entries that counts."""
    if x is None or y is None:
        return y if x is None else x
    if x[0] != y[0]:
        return x if x[0] < y[0] else y
    return y if less(y[1], x[1]) else x


def product(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for row in x:
        line = [None] * 4
        for k, e in enumerate(row):
            if e is None:
                continue
            for j, f in enumerate(y[k]):
                if f is not None and (line[j] is None or e[0] + f[0] <= line[j][0]):
                    line[j] = better(line[j], (e[0] + f[0], join(e[1], f[1])))
        out.append(line)
    return out


def identity(n: int = 4) -> Matrix:
    return [[(0, EMPTY) if i == j else None for j in range(4)] for i in range(n)]


def _inserts() -> Matrix:
    one = [[None] * 4 for _ in range(4)]
    for (i, r), j in MOVES.items():
        if r in "ua":
            one[i][j] = (INSERT, leaf("I"))
    stay = identity()
    some = [[better(a, b) for a, b in zip(x, y, strict=True)] for x, y in zip(stay, one, strict=True)]
    # three inserts in a row repeat a state
    return product(some, some)


def _edits(symbol: str) -> Matrix:
    role, late = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, leaf("D"))
        if symbol == "X":
            continue
        for r in "sua":
            if (i, r) in MOVES and (r == role or r != "s"):
                edit = (KEEP + late, leaf("K")) if r == role else (REROLE + late, leaf("R"))
                out[i][MOVES[i, r]] = better(out[i][MOVES[i, r]], edit)
    return out


INSERTS = _inserts()


def symbol_matrices() -> dict[int, Matrix]:
    return {c: product(INSERTS, _edits(s)) for c, s in enumerate(SYMBOLS)}


def evaluate(rules: list[tuple[int, int]]) -> dict[int, Matrix]:
    """Matrices of the symbols and, bottom-up, of the rules."""
    found = symbol_matrices()
    for left, right in rules:
        found[len(found)] = product(found[left], found[right])
    return found


# ------------------------------------------------------------------ the rows

def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with the faults that the checksum
    of their place plants."""
    def word(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"),
                                (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("fault"))
    text = (F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.where("fault <> 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(copies).alias("copy")).drop("copy"))


def _conv() -> Column:
    return F.coalesce(F.concat(F.lit("1"), F.col("conv_id").cast("string")), F.lit("0"))


def _in_order(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``at``, a number that grows with their order, and (at,
    conv, r, fault) with the role initial and the first fault of each row."""
    head = F.substring("text", 1, 64)
    bare = F.rtrim("text", F.lit(SPACE))
    order = ["conv", "turn", "role", "head"]
    ranged = stored(rows.select(_conv().alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"))
                    .withColumn("head", head).repartitionByRange(*order).sortWithinPartitions(*order, "text")
                    .withColumn("at", F.monotonically_increasing_id()).drop("head"), "rows")
    flags = stored(ranged.select("at", "conv", "role", F.substring("role", 1, 1).alias("r"), F.sha2("text", 256).alias("h"),
                                 (F.length(bare) == 0).alias("blank"),
                                 (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut")), "flags")
    # the place of the first row with this role and text; a place is one row's own
    firsts = flags.groupBy("conv", "role", "h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0))
    faults = stored(flags.join(firsts, "at", "left").select("at", "conv", "r", fault.alias("fault")), "faults")
    return ranged, faults


def _segments(faults: DataFrame) -> DataFrame:
    """(conv, segment, symbols): the rows of each conversation in stretches."""
    known = F.when(F.col("r").isin("s", "u", "a"), F.col("r")).otherwise(F.lit("o"))
    symbol = (F.when(F.col("fault").isin(1, 2), "X").when(F.col("fault") == 3, F.upper(known)).otherwise(known))
    return (faults.select("conv", F.shiftright("at", BLOCK_BITS).alias("segment"), F.struct("at", symbol.alias("s")).alias("x"))
            .groupBy("conv", "segment").agg(F.array_sort(F.collect_list("x")).alias("xs"))
            .select("conv", "segment", F.concat_ws("", F.transform("xs", lambda x: x["s"])).alias("symbols")))


# ------------------------------------------------------------------ grammar

def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for codes in batch.column("codes").to_pylist():
            seen.update(zip(codes, codes[1:], strict=False))
    keys = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                      pa.array([seen[k] for k in keys], pa.int64())], names=["a", "b", "k"])


def rewrite(codes: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """Replaces the pairs of the rules from left to right."""
    out, i, n = [], 0, len(codes)
    while i < n:
        rule = rules.get((codes[i], codes[i + 1])) if i + 1 < n else None
        out.append(codes[i] if rule is None else rule)
        i += 1 if rule is None else 2
    return out


def grammar(distinct: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(symbols, codes) of each distinct segment in the symbols of the grammar,
    and its rules in the order of their codes from ``len(SYMBOLS)``."""
    codes = F.transform(F.split("symbols", ""), lambda s: F.call_function("instr", F.lit(SYMBOLS), s) - 1)
    rows, rules = distinct.select("symbols", codes.alias("codes")), []
    while True:
        rows = stored(rows, "codes")
        pairs = (rows.select("codes").mapInArrow(_count_pairs, PAIRS).groupBy("a", "b").agg(F.sum("k").alias("k"))
                 .where("k > 1").orderBy(F.desc("k"), "a", "b").limit(min(RULES_A_ROUND, RULES - len(rules))).collect())
        if not pairs:
            return rows, rules
        first = len(SYMBOLS) + len(rules)
        rules += [(p.a, p.b) for p in pairs]
        new = {pair: first + i for i, pair in enumerate(rules[first - len(SYMBOLS):])}

        def apply(batches, new=new):
            for batch in batches:
                out = [rewrite(c, new) for c in batch.column("codes").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("symbols"), pa.array(out, pa.list_(pa.int32()))], names=["symbols", "codes"])
        rows = rows.mapInArrow(apply, "symbols string, codes array<int>")


def transfers(coded: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """(symbols, entries): the matrix of each distinct segment, 16 entries of
    cost and audit."""
    matrices = evaluate(rules)

    def run(batches):
        for batch in batches:
            costs, audits = [], []
            for codes in batch.column("codes").to_pylist():
                m = identity()
                for c in codes:
                    m = product(m, matrices[c])
                costs.append([None if e is None else e[0] for row in m for e in row])
                audits.append([None if e is None else flat(e[1]) for row in m for e in row])
            yield pa.RecordBatch.from_arrays([batch.column("symbols"), pa.array(costs, pa.list_(pa.int64())),
                                              pa.array(audits, pa.list_(pa.string()))], names=["symbols", "costs", "audits"])
    return coded.mapInArrow(run, "symbols string, costs array<long>, audits array<string>")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Product of the segments of each conversation, from the first state on."""
    def close(conv, vector):
        ends = product(vector, INSERTS)[0]
        best = None
        for j in ACCEPTED:
            best = better(best, ends[j])
        return conv, best[0], flat(best[1])

    conv, vector, out = None, None, []
    for batch in batches:
        for c, costs, audits in zip(*(batch.column(x).to_pylist() for x in ("conv", "costs", "audits")), strict=True):
            if c != conv:
                if conv is not None:
                    out.append(close(conv, vector))
                conv, vector = c, identity(1)
            entries = [None if k is None else (k, leaf(a)) for k, a in zip(costs, audits, strict=True)]
            vector = product(vector, [entries[4 * i:4 * i + 4] for i in range(4)])
        if len(out) > 4096:
            yield _audits(out)
            out = []
    if conv is not None:
        out.append(close(conv, vector))
    yield _audits(out)


def _audits(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.string())], names=["conv", "cost", "audit"])


# ------------------------------------------------------------------- applying

class _Writer:
    """Applies the audit of one conversation to its rows as they come."""

    def __init__(self, conv: str, cost: int | None, audit: str | None):
        self.conv, self.cost, self.audit = conv, cost or 0, audit or ""
        self.at = self.state = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.turn = self.r = None
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        self.state = MOVES[self.state, role[:1]]

    def expected(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(self.expected(), "")
            self.at += 1

    def row(self, turn: int | None, role: str, text: str, r: str, fault: int) -> None:
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.turns = turn, self.turns + 1
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        self.illegal += self.r is not None and self.r + r not in ("su", "ua", "au")
        self.r = r
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.line(role if edit == "K" else self.expected(), text)

    def result(self) -> tuple:
        self.inserts()
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest())


def _repaired(rows: list[tuple]) -> pa.RecordBatch:
    fields = [(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in REPAIRED.split(", "))]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer, out = None, []
    for batch in batches:
        for conv, at, turn, role, text, r, fault, cost, audit in zip(*(batch.column(c).to_pylist() for c in (
                "conv", "at", "turn", "role", "text", "r", "fault", "cost", "audit")), strict=True):
            if at < 0:  # the audit of a conversation stands before its rows
                if writer:
                    out.append(writer.result())
                writer = _Writer(conv, cost, audit)
            else:
                writer.row(turn, role, text, r, fault)
        if len(out) > 4096:
            yield _repaired(out)
            out = []
    if writer:
        out.append(writer.result())
    yield _repaired(out)


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conv_id of ``ids``: counts of gaps and faults in ``rows``
    (conv_id, turn, role, text), the cost and audit of the cheapest repair and
    the digest of the repaired conversation."""
    ordered, faults = _in_order(rows)
    segments = stored(_segments(faults), "segments")
    coded, rules = grammar(segments.select("symbols").distinct())
    solved = segments.join(transfers(coded, rules), "symbols").select("conv", "segment", "costs", "audits")
    audits = (solved.repartition("conv").sortWithinPartitions("conv", "segment")
              .mapInArrow(_fold, "conv string, cost long, audit string"))
    convs = ids.select("conv_id").distinct().withColumn("conv", _conv())
    empty = {"turn": "long", "role": "string", "text": "string", "r": "string", "fault": "int"}
    heads = stored(convs.select("conv").join(audits, "conv", "left"), "audits").select(
        "conv", F.lit(-1).cast("long").alias("at"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "cost", "audit")
    told = ordered.join(faults.select("at", "r", "fault"), "at").select(
        "conv", "at", F.col("turn").cast("long").alias("turn"), "role", "text", "r", "fault",
        F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"))
    done = (heads.unionByName(told).repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_apply, REPAIRED))
    return convs.join(done, "conv").drop("conv")
