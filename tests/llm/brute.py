"""Plain Python versions of the contracts, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\f\r"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    w = space_words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover),
            "base_failed": len(w) < 50 or 100 * len(cover) > 50 * len(w)}


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def pii(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    names = ("email", "ip", "card", "phone")
    n = Counter(k for _, k, _ in out)
    return {**{f"n_{x}": n[i] for i, x in enumerate(names)},
            "base_sha256": sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in out))}


def contamination(docs, bench):
    wins = defaultdict(set)
    for item, text in bench:
        w = alnum_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[i:i + 10])].add(item)
    sizes = {len(x) for x in wins}
    out = []
    for doc, text in docs:
        w, hit, items = alnum_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i:i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit)))
    return out


def line_dedup(docs, min_docs=10):
    key = lambda x: x.strip(SPACE).translate(UP)
    seen = defaultdict(set)
    for doc, text in docs:
        for x in (text or "").split("\n"):
            if key(x):
                seen[key(x)].add(doc)
    out = []
    for doc, text in docs:
        ls = (text or "").split("\n")
        kept = [x for x in ls if len(seen.get(key(x), ())) < min_docs]
        out.append((doc, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def near_duplicates(docs):
    sets = []
    for _, text in docs:
        w = space_words((text or "").translate(UP))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                    parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(docs)]


def base_licenses(text):
    w = alnum_words(text)
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
