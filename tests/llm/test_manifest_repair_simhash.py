"""Operators 11 to 13 against plain Python versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from segstate.llm import merkle, repair, simhash
from tests.conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx int, fp long, first string, n string"
TOLD = "conv_id long, turn long, role string, text string, conv string, at int, fault string, audit string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- manifest

def brute_leaf(d, source, lang, n, text):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(field(v) for v in (d, source, lang, n, text)))


def brute_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i:i + 3])) for i in range(0, len(x), 3)])
    return levels


def brute_path(levels, i):
    for x in levels[:-1]:
        lo = i // 3 * 3
        yield x[lo:i], x[i + 1:lo + 3]
        i //= 3


def brute_manifest(rows):
    """rows (doc_id, text, lang, source, n_chars) -> sorted results."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0], brute_leaf(r[0], r[3], r[2], r[4], r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda g: (g[0], g[1] or 0, g[2]))
        trees[s] = brute_tree([g[2] for g in groups[s]])
    top = brute_tree([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for i, (_, d, leaf, r) in enumerate(groups[s]):
            path = list(brute_path(trees[s], i)) + list(brute_path(top, k))
            folded = leaf
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and r[1] is not None:
                folded = brute_leaf(d, s, r[2], r[4], r[1].replace("\n", ""))
            for left, right in path:
                folded = sha("".join(left) + folded + "".join(right))
            out.append((d, leaf, trees[s][-1][0], root, sha("".join("".join(a) + "".join(b) for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["", "ü", "z", None, f"s{i}"])
        text = rng.choice([None, "", "a\nb", "plain ü", "x" * 50 + "\n"])
        rows.append((rng.choice([i, i, None, 7]), text, rng.choice([None, "en"]), source, rng.choice([None, i])))
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 400])
def test_manifest(spark, monkeypatch, n):
    # small stretches and partitions, so that tiers and requests of every level occur
    monkeypatch.setattr(merkle, "BLOCK", 5)
    rows = manifest_rows(n)
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], DOCS)
    leaves, tops, nodes = merkle.manifest(df, merkle.tampered_text())
    got = merkle.multiproofs(leaves, tops, nodes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)


def test_manifest_large_tree_and_subset(spark):
    """A tree of two tiers, and proofs of some leaves only."""
    rows = [(i, f"t\n{i}", "en", "one" if i % 5 else "two", i) for i in range(9000)]
    df = spark.createDataFrame(rows, DOCS.split(", tree")[0]).repartition(7)
    want = {r[0]: r for r in brute_manifest(rows)}
    leaves, tops, nodes = merkle.manifest(df, merkle.tampered_text())
    got = merkle.multiproofs(leaves.where("doc_id % 37 = 3"), tops, nodes).collect()
    assert len(got) == len(range(3, 9000, 37)) and all(tuple(r) == want[r.doc_id] for r in got)


def test_manifest_sf(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = merkle.multiproofs(*merkle.manifest(docs, merkle.tampered_text()))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows)


def test_manifest_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle.multiproofs(*merkle.manifest(df, merkle.tampered_text())).collect() == []


def test_missing_is_minimal():
    assert [(lv, m.tolist()) for lv, _, m in merkle.missing(merkle.np.array([4, 5, 6]), 11)] == [
        (0, [3, 7, 8]), (1, [0]), (2, [1])]


# ------------------------------------------------------------------ repair

def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_audit(rows, faults):
    """Cheapest first, over whole audit strings, by length of the row prefix."""
    best = {"": (0, "", ())}  # role initials so far -> (cost, audit, lines)
    ok = re.compile(r"(s?(ua)*u?)?")

    def insert(states):
        for _ in range(3):
            for roles, (c, a, ls) in list(states.items()):
                for r in ("user", "assistant"):
                    add(states, roles + r[0], (c + 2, a + "I", (*ls, r + ":")))
        return states

    def add(states, roles, entry):
        if not ok.fullmatch(roles):
            return
        # what is to come depends on the last role only; an s cannot stand alone at the end
        roles = roles[:1] if len(roles) == 1 else "ua" if roles[-1:] == "a" else "u" if roles[-1:] == "u" else ""
        if roles not in states or entry[:2] < states[roles][:2]:
            states[roles] = entry

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for roles, (c, a, ls) in insert(best).items():
            add(new, roles, (c + 3, a + "D", ls))
            if fault in ("blank", "duplicate"):
                continue
            late = fault == "truncated"
            add(new, roles + (role[:1] or "?"), (c + late, a + "K", (*ls, f"{role}:{text}")))
            for r in ("user", "assistant"):
                add(new, roles + r[0], (c + 2 + late, a + "R", (*ls, f"{r}:{text}")))
        best = new
    ends = [e for roles, e in insert(best).items() if roles in ("", "ua")]
    return min(ends, key=lambda e: e[:2])


def brute_repair(rows):
    damaged, out = brute_damage(rows), []
    for conv in {r[0] for r in rows}:
        mine = sorted([r[1:] for r in damaged if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = brute_faults(mine)
        turns = {r[0] for r in mine} - {None}
        initials = [r[1][:1] for r in mine]
        cost, audit, lines = brute_audit(mine, faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


def told_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", None, "", "Ünknown"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((None if c == 3 else c, rng.choice([t, t, t, t, t + 1, None]), role,
                         rng.choice(["Hi.", "same!", "cut off", " \t\x0b", "", None, f"text {t}? ", f"long {'é' * 500} {t}.", "a\nb."])))
    return rows


@pytest.mark.parametrize("block", [2, 12])
def test_repair(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK_BITS", block)  # segments of four rows cross conversations
    rows = told_rows(4, 120, 14) + [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)]
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], TOLD).repartition(5)
    got = repair.repair(repair.damage(df), df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repair(rows)


def test_repair_sf(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = repair.repair(repair.damage(df), df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repair(rows)


def test_repair_without_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    got = repair.repair(df.where("turn > 1"), df).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert repair.repair(df.where("turn > 1"), df.where("turn > 1")).collect() == []


def test_transfer_matrices_exhaustive():
    """Every audit of every short symbol sequence, tried out."""
    matrices = repair.symbol_matrices()

    def outcomes(symbols):
        for gaps in itertools.product(range(4), repeat=len(symbols) + 1):
            for edits in itertools.product("DKR", repeat=len(symbols)):
                audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:], strict=True))
                for choice in itertools.product("ua", repeat=sum(gaps) + edits.count("R")):
                    free, at, cost, roles = iter(choice), 0, 0, ""
                    for e in audit:
                        if e == "I":
                            cost, roles = cost + 2, roles + next(free)
                            continue
                        s, at = symbols[at], at + 1
                        if e != "D" and s == "X":
                            break
                        cost += 3 if e == "D" else s.isupper() + (2 if e == "R" else 0)
                        roles += "" if e == "D" else next(free) if e == "R" else s.lower()
                    else:
                        if re.fullmatch("(s?(ua)+)?", roles):
                            yield cost, audit

    sequences = [*itertools.product(repair.SYMBOLS, repeat=1), *random.Random(2).sample([*itertools.product(repair.SYMBOLS, repeat=2)], 25)]
    for symbols in sequences:
        vector = repair.identity(1)
        for s in symbols:
            vector = repair.product(vector, matrices[repair.SYMBOLS.index(s)])
        ends = repair.product(vector, repair.INSERTS)[0]
        best = repair.better(ends[0], ends[3])
        assert (best[0], repair.flat(best[1])) == min(outcomes(symbols)), symbols


def test_rope_order():
    rng = random.Random(3)
    for _ in range(2000):
        x, y = ("".join(rng.choice("DIK") for _ in range(8)) for _ in range(2))

        def rope(s):
            if len(s) < 2:
                return repair.leaf(s)
            k = rng.randrange(1, len(s))
            return repair.join(rope(s[:k]), rope(s[k:]))
        assert repair.less(rope(x), rope(y)) == (x < y) and repair.flat(rope(x)) == x


# ----------------------------------------------------------------- simhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    ids = list(range(len(fps)))

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            ids[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def brute_simhash(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (d, _), c in zip(rows, comp, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((d, f"{fp:016x}", least.get(c)) for (d, _), fp, c in zip(rows, fps, comp, strict=True)), key=str)


def simhash_rows():
    rng = random.Random(9)
    words = [f"Wörd{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "one", "One  two", "a b c", "A\tB\x0bc", "x\x1cy z"])]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(2, 60)))) for i in range(60)]
    return rows + [(None, " ".join(base)), (100, rows[8][1]), (None, "only row without an id")]


def simhash_result(df):
    got = simhash.near_duplicates(df).select("doc_id", simhash.hex_digits(), "component_id").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_simhash(spark):
    rows = simhash_rows()
    df = spark.createDataFrame([(d, t, "en", "s", 1, "x", 1, 2, "y", "z") for d, t in rows], DOCS).repartition(4)
    assert simhash_result(df) == brute_simhash(rows)


def test_simhash_sf(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert simhash_result(docs) == brute_simhash([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_simhash_pieces(monkeypatch):
    text = " ".join(f"w{i % 17} ü{'y' * (i % 40)}" for i in range(900)) + "  "
    monkeypatch.setattr(simhash, "PIECE_BYTES", 64)
    assert simhash.fingerprint(memoryview(text.encode())) == brute_fingerprint(text)


def test_simhash_links_exactly(spark):
    """Dense clusters of fingerprints, with distances of 1 to 4."""
    rng = random.Random(1)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(12):
            y = x
            for _ in range(rng.randrange(1, 4)):
                y ^= 1 << rng.randrange(64)
            fps.append(y)
            x = y if rng.random() < 0.3 else x
    fps = sorted(set(fps) | {0, 1, 3, 7, 2**64 - 1, 2**64 - 4})
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    # an edge may join two fingerprints through a third, within the component
    want = dict(zip(fps, brute_components(fps), strict=True))
    assert all(want[a] == want[b] for a, b in edges)
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    assert len({find(x) for x in fps}) == len(set(want.values()))


def test_simhash_empty(spark):
    assert simhash_result(spark.createDataFrame([], DOCS)) == []


def test_tampered_text(spark):
    df = spark.createDataFrame([(i, "a\nb") for i in range(40)] + [(None, "a\nb")], "doc_id long, text string")
    for r in df.select("doc_id", merkle.tampered_text().alias("t")).collect():
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        assert r.t == ("ab" if hit else "a\nb")
    assert df.select(F.count("*")).first()[0] == 41
