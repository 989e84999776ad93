"""Every operator against its plain Python version, on documents with nulls,
empty and long texts, ties, repeated rows and columns of clashing names."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from segstate.llm import bpe, chat, fmindex, hosts, licenses, lines, neardup, paragraphs, pii, quality
from segstate.llm.catalog import vocabulary_path
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rk string, rid string, h int, cid string"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, start=0):
    rows = [(start + i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1],
             ("en", "de", None)[i % 3], "s", 0, "x", "y", 1, "z") for i, t in enumerate(texts)]
    return [(r[0], r[1]) for r in rows], spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=("the", "of", "and", "Thing", "ouïe", "Straße,", "x1", "end.")):
    return " ".join(rng.choice(words) + (str(rng.randrange(400)) if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    base = prose(rng, 300)
    passage = prose(rng, 80)
    long = prose(rng, 30000)
    texts = [None, "", " ", "\n\n", "one", "Two words\n", "a b c d", base, base, base.upper(), base + " tail",
             base.replace("the", "teh", 3), base.replace("of", "fo", 60), prose(rng, 60) + " " + passage + " " + prose(rng, 60),
             prose(rng, 90) + "\n" + prose(rng, 20) + " " + passage + " " + prose(rng, 40), long, long + " x",
             "de " * 400, "same line here\nsame line here\n" + prose(rng, 70), "a\x1cb \u00a0c \u2003 \u0085d İΣ ﬁ e\u0301",
             "a@b.c x a@b@c.d mail a.b%c@d-e.f.g.h, 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00000001.2.3.4",
             "card 4111 1111 1111 1111 x 4111-1111-1111-1112 +1 (555) 555-0100, +49 30 123456 password=a1b2c3d4e5",
             "MIT License apache-license; GNU General Public License, version 3. mit\nlicense",
             "Licensed under CC BY-NC 4.0. " + prose(rng, 30), (8, base), (None, base), (None, None), (15, "é" * 3000)]
    texts += [f"{prose(rng, 20)}\n \tShared LINE of all \x0b\n{prose(rng, 12)}" for _ in range(14)]
    texts += [f"{prose(rng, 8)}\nRare line\n\n" for _ in range(9)]
    return make(spark, texts)


def test_quality(corpus):
    docs, df = corpus
    got = quality.quality(df).collect()
    assert len(got) == len(docs)
    want = sorted((str(d), *brute.quality(t).values()) for d, t in docs)
    cols = list(brute.quality("").keys())
    assert sorted((str(r.doc_id), *(r[c] for c in cols)) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_verdict(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["the", "of", "and", "thing", "other", "words", "here."]) + " " + prose(rng, 1)
                      for _ in range(90)) for _ in range(30)]
    junk = ["".join(rng.choice("#%&*$") * 3 + str(i) + " " for i in range(200))]
    _, df = make(spark, clean + junk)
    kept = {r.doc_id: r.kept for r in quality.quality(df.withColumn("lang", F.lit("en"))).collect()}
    assert all(kept[i] for i in range(30)) and not kept[30]


def test_quality_rejects_text_without_common_words(spark):
    """A long text of none of the common words is compared and goes."""
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["the", "of", "and", "is", *[f"word{rng.choice('abcdef')}"] * 8]) + " " +
                      "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(90)) for _ in range(30)]
    rare = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200))
    _, df = make(spark, [*clean, rare])
    rows = {r.doc_id: r for r in quality.quality(df.withColumn("lang", F.lit("en"))).collect()}
    assert all(rows[i].kept for i in range(30))
    assert not rows[30].base_failed and not rows[30].kept and rows[30].word_distance > quality.WORD_FLOOR


def test_distance_matches_plain_form(spark):
    import math
    a, b = [0.375, 0.0, 0.625], [0.2, 0.8, 0.0]
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(
        quality.js_distance(F.col("a"), F.col("b")).alias("d")).first()
    p, q = a, b
    m = [(x + y) / 2 for x, y in zip(p, q)]
    kl = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u)
    assert row.d == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_pii(corpus):
    docs, df = corpus
    got = pii.personal_data(df).collect()
    want = sorted((str(d), *brute.pii(t).values()) for d, t in docs)
    cols = list(brute.pii("").keys())
    assert sorted((str(r.doc_id), *(r[c] for c in cols)) for r in got) == want
    assert any("id:" in r.spans for r in got if r.doc_id == 21)


def test_pii_random_spans():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@-+ 29(5)\n0") for _ in range(rng.randrange(60)))
        spans = pii.base_spans(text)
        names = ("email", "ip", "card", "phone")
        assert brute.sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)) == brute.pii(text)["base_sha256"], text


def test_pii_bootstrap_discovers_unseen(spark):
    """The word before seeds promotes it; other identifiers after it follow."""
    rng = random.Random(2)
    seeds = [f"{prose(rng, 9)} Contact: user{i}@mail{i}.example.com now" for i in range(12)]
    _, df = make(spark, [*seeds, "please Contact: user77@mail77 now", "the chapter of user77x thing"])
    spans = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert "email" in spans[0] and "id" not in spans[13]


def test_pii_contexts_of_whole_spans(spark):
    """Words around whole spans find identifiers of other forms: after emails
    without digits, before and after spaced phones and cards in groups."""
    rng = random.Random(7)
    names = ("anna", "bob", "carl", "dora", "emil", "fred", "gina", "hans")
    cards = ("4111 1111 1111 1111", "5500 0000 0000 0004", "3782 822463 10005", "6011 0000 0000 0004")
    texts = [f"{prose(rng, 5)} Contact: {n}@example.com now" for n in names]
    texts += [f"{prose(rng, 5)} Call +1 ({200 + i}) 555-38{i}4 today" for i in range(8)]
    texts += [f"{prose(rng, 5)} Kartennummer {c} bitte" for c in cards]
    first = len(texts)
    texts += ["please Contact: user77@mail77 now", "please Contact: staff-20931 soon", "you Call 0049-30-1234x later",
              "meine Kartennummer AB-99120-X hier", "with password=hunter and", "the chapter of user77x thing"]
    _, df = make(spark, texts)
    spans = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    for i, unseen in enumerate(("user77@mail77", "staff-20931", "0049-30-1234x", "AB-99120-X", "password=hunter")):
        at = texts[first + i].index(unseen)
        assert spans[first + i] == f"id:{at}:{at + len(unseen)}", unseen
    assert spans[first + 5] == "" and all("id" not in spans[i] for i in range(8))


def test_pii_finds_the_secrets_of_the_table(spark):
    """Every planted secret of the whole table, and no clean document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    planted = {d: [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)] for d, t in texts.items()}
    planted = {d: s for d, s in planted.items() if s}
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(planted) == 12
    for d, spans in planted.items():
        assert all(f"id:{a}:{b}" in got[d].spans.split(",") for a, b in spans), d
    assert {d for d, r in got.items() if r.n_id} == set(planted)
    assert all(r.has_personal_data == (r.spans != "") for r in got.values())


def test_pii_written_forms(spark):
    """Prefixes over spaces and quotes, marks at the edges, long tokens that differ
    at their end, and rounds that follow each other."""
    long = "x1" * 400
    texts = ["my password : hunter now", "api_key='abc'", 'Token="q"', "secret\t=\tzz%%%", "monkey = 5", "a token is here",
             f"password={long}a", f"password={long}b", "key=", "token = "]
    _, df = make(spark, texts)
    spans = {r.doc_id: [texts[r.doc_id][int(a):int(b)] for _, a, b in (s.split(":") for s in r.spans.split(",") if s)]
             for r in pii.personal_data(df).collect()}
    assert spans == {0: ["hunter"], 1: ["api_key='abc"], 2: ['Token="q'], 3: ["zz"], 4: [], 5: [], 6: [f"password={long}a"],
                     7: [f"password={long}b"], 8: [], 9: []}
    one, two = (pii.token_occurrences(t, [])[0]["instance"] for t in texts[6:8])
    assert one != two and len(one) < 100


def test_pii_long_text_in_linear_time():
    text = "a@b.cd," * 40_000 + " token = " + "9" * 100_000
    start = time.process_time()
    assert len(pii.token_occurrences(text, pii.base_spans(text))) > 30_000
    assert time.process_time() - start < 20


def test_promotion_rounds(spark):
    """Plain version of the scoring loop."""
    rows = [(f"p{i % 4}", f"i{i % 9}", i % 9 < 4) for i in range(60)] + [("P:password=", "zz", False)]
    edges = {(p, i): s for p, i, s in rows}
    trust, good, before = {i: 1.0 for (p, i), s in edges.items() if s}, {}, None
    while before != good:
        before, good = good, {}
        for p in {p for p, _ in edges}:
            own = [trust.get(i, 0.0) for q, i in edges if q == p]
            if p[:2] == "P:" or sum(own) / len(own) >= 0.8 and sum(t >= 0.8 for t in own) >= 3:
                good[p] = 1.0 if p[:2] == "P:" else round(sum(own) / len(own), pii.DIGITS)
        for p, i in edges:
            if p in good:
                trust[i] = max(trust.get(i, 0.0), good[p])
    got = pii.promoted_patterns(spark.createDataFrame(rows, "pattern string, instance string, seed boolean")).collect()
    assert {r.pattern: pytest.approx(r.score) for r in got} == good


def test_contamination(spark, corpus):
    docs, df = corpus
    bench = [(1, " ".join(docs[13][1].split()[65:85])), (2, "two WORDS"), (3, ""), (4, None), (1, "de de de"),
             (10, "mit license apache license gnu general public license version 3 mit license"), (11, "absent words only")]
    table = spark.createDataFrame(bench + [(None, "the")], "item_id long, text string")
    want = sorted((str(x[0]), *x[1:]) for x in brute.contamination(docs, bench))
    got = fmindex.contamination(df, table).collect()
    cols = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((str(r.doc_id), *(r[c] for c in cols)) for r in got) == want
    assert sum(r.contaminated for r in got) > 3


def test_contamination_in_blocks(spark, corpus, monkeypatch):
    docs, df = corpus
    words = docs[7][1].split()
    bench = [(i, " ".join(words[i * 7:i * 7 + 15])) for i in range(12)]
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", 200)
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert len(list(fmindex.blocks_of(table))) > 2
    got = fmindex.contamination(df, table).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(
        (str(x[0]), *x[1:]) for x in brute.contamination(docs, bench))


def test_fm_index_finds_all():
    import numpy as np
    rng = np.random.default_rng(0)
    for _ in range(60):
        s = np.append(rng.integers(0, 4, rng.integers(1, 120)), 0)
        index = fmindex.FMIndex(s, 3)
        pats = [rng.integers(1, 4, rng.integers(1, 5)) for _ in range(8)]
        table = np.zeros((8, 5), dtype=np.int64)
        for i, p in enumerate(pats):
            table[i, :len(p)] = p
        low, high = index.search(table, np.array([len(p) for p in pats]))
        for p, a, b in zip(pats, low, high):
            want = [i for i in range(len(s) - len(p) + 1) if (s[i:i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_lines(corpus):
    docs, df = corpus
    got = lines.apply_bitmaps(df, lines.dedup_lines(df)).select("doc.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(x[0]), *x[1:]) for x in brute.line_dedup(docs))
    assert sum(r.n_dropped for r in got) >= 14


def test_lines_keep_first(spark):
    docs, df = make(spark, ["a\nb\na", "B \nc", None, "b\na\n\nc"])
    got = lines.apply_bitmaps(df, lines.dedup_lines(df, min_docs=1, keep_first=True)).select("doc.doc_id", "kept").collect()
    assert {r[0]: r[1] for r in got} == {0: "a\nb", 1: "c", 2: "", 3: ""}


def test_near_duplicates(corpus):
    docs, df = corpus
    got = neardup.near_duplicates(df).collect()
    want = sorted((str(d), n, str(c if n else d)) for d, n, c in brute.near_duplicates(docs))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_near_duplicates_many_groups(spark):
    """Chains and groups whose members link only through others."""
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        w = prose(rng, 80).split()
        for _ in range(12):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(2):
                w[rng.randrange(len(w))] = str(rng.random())
    rng.shuffle(texts)
    docs, df = make(spark, texts)
    want = {d: c for d, _, c in brute.near_duplicates(docs)}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == want


def test_sketch_estimates_similarity():
    import numpy as np
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 200).astype(np.uint64)])
    for n in (1, 3, 900):
        s = neardup.fast_similarity_sketch(np.concatenate([a[:n], b[:n]]), np.array([n, n]))
        true = len(set(a[:n]) & set(b[:n])) / len(set(a[:n]) | set(b[:n]))
        assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_paragraphs(spark, corpus):
    docs, df = corpus
    got = paragraphs.repeated_passages(df).collect()
    flagged = {r.doc_id for r in got}
    assert {13, 14, 7, 8, 9, 10, 15, 16} <= flagged
    assert not flagged & {4, 5, 6, 23}
    words = {d: (t or "").lower().split() for d, t in docs if d not in (8, 15, None)}
    mine = [r for r in got if r.doc_id == 14]
    assert all(" ".join(words[14][r.start:r.end])[20:60] in " ".join(words[13]) for r in mine)


def test_paragraph_recall(spark):
    """Passages of 60 words inside unrelated texts, some with a changed word."""
    rng = random.Random(11)
    texts, planted = [], set()
    for g in range(40):
        p = prose(rng, 60, words=[f"w{rng.randrange(900)}" for _ in range(60)]).split()
        for c in range(3):
            q = list(p)
            if c == 2:
                q[30] = "changed"
            planted.add(len(texts))
            texts.append(" ".join([prose(rng, 50 + c * 3, [f"u{rng.randrange(99999)}" for _ in range(80)]), *q,
                                   prose(rng, 40, [f"v{rng.randrange(99999)}" for _ in range(80)])]))
    clean = len(texts)
    texts += [prose(rng, 200, [f"c{rng.randrange(99999)}" for _ in range(200)]) for _ in range(40)]
    _, df = make(spark, texts)
    found = {r.doc_id for r in paragraphs.repeated_passages(df).collect()}
    assert len(found & planted) >= 0.9 * len(planted)
    assert not {d for d in found if d >= clean}


def test_paragraphs_in_short_lines_and_with_a_changed_word(spark):
    """A passage wrapped in lines of 4 words or of 9 is found, and a written
    paragraph with one changed word goes as a whole."""
    rng = random.Random(12)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    wrap = lambda ws, n: "\n".join(" ".join(ws[i:i + n]) for i in range(0, len(ws), n))
    verse, para = own(60), own(60)
    changed = [*para[:30], "changed", *para[31:]]
    texts = [wrap(verse, 4), "\n".join([wrap(own(40), 4), wrap(verse, 4), wrap(own(20), 4)]), wrap(own(30), 7) + "\n" + wrap(verse, 9),
             "\n".join([" ".join(own(50)), " ".join(para), " ".join(own(50))]),
             "\n".join([" ".join(own(70)), " ".join(changed), " ".join(own(40))]), " ".join(own(90))]
    _, df = make(spark, texts)
    rows = paragraphs.repeated_passages(df).collect()
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) and set(got) == {0, 1, 2, 3, 4}
    for d, at in ((1, 40), (2, 30)):
        assert got[d].start <= at + 20 and got[d].end >= at + 40 and got[d].first_doc_id == 0 and got[d].n_removed >= 30
    assert (got[4].start, got[4].end, got[4].n_removed, got[4].first_doc_id) == (70, 130, 60, 3)
    assert (got[3].start, got[3].end, got[3].n_removed) == (50, 110, 0)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "</s>\n<s>[user]\n\\[x]"), (2, 5, "assistant", ""),
            (2, 5, "assistant", ""), (3, 0, "system", "é" * 10), (3, 7, "assistant", "a<b\\"), (None, 0, "user", "kept"), (None, 1, "assistant", "too")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    got = {r.tree: r for r in chat.read_back(chat.format_paths(chat.chosen_paths(chat.chains(df)))).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        own = [(r or "", t or "") for i, _, r, t in rows if i == c]
        said = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), brute.sha("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), brute.sha(said))


def test_reply_trees(spark):
    """The best branch of random trees against plain enumeration."""
    rng = random.Random(6)
    rows = []
    for tree in range(6):
        for n in range(30):
            rows.append((tree, n, rng.randrange(n) if n else None, "user", f"t{n}", float(rng.randrange(5))))
    rows += [(9, 1, 2, "user", "loop", 1.0), (9, 2, 1, "user", "loop", 1.0), (10, 1, 77, "user", "orphan", None),
             (10, 1, 77, "user", "orphan", None)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {}
    for r in chat.chosen_paths(df, branches=2).collect():
        got.setdefault((r.tree, r.rank), []).append((r.depth, r.text))
    for tree in range(6):
        own = {n: (p, s) for t, n, p, _, _, s in rows if t == tree}
        paths = []
        for leaf in set(own) - {p for p, _ in own.values()}:
            path, n = [], leaf
            while n is not None:
                path.append(n)
                n = own[n][0]
            paths.append((-sum(own[x][1] for x in path) / len(path), leaf, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(paths)[:2], 1):
            assert [t for _, t in sorted(got[tree, rank])] == [f"t{n}" for n in path]
    assert (9, 1) not in got and got[10, 1] == [(1, "orphan")]


def test_bpe(corpus):
    from tokenizers import Tokenizer
    docs, df = corpus
    lib = Tokenizer.from_file(vocabulary_path())
    lib.no_padding()
    lib.no_truncation()
    want = []
    for d, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((str(d), len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(lib.decode(ids, skip_special_tokens=False))))
    got = bpe.encode_digest(df, vocabulary_path()).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    one = df.where("doc_id = 7")
    back = bpe.decode(bpe.encode(one, vocabulary_path()), vocabulary_path()).first()
    assert brute.sha(back.text) == next(w[3] for w in want if w[0] == "7")


def test_bpe_words_and_specials():
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary_path())
    v = bpe.Vocabulary(vocabulary_path())
    rng = random.Random(8)
    texts = ["<|endoftext|>a<|startoftext|> b<|endoftext|", "it's WE'LL 12½", "日本 😀👍🏽 हिन्दी", "x\x00\x01y"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé'. ") for _ in range(40)) for _ in range(300)]
    for text, got in zip(texts, v.encode_batch(texts)):
        assert " ".join(c[0] for c in got if c[1]) == " ".join(map(str, lib.encode(text, add_special_tokens=False).ids)), text


def test_licenses(corpus):
    docs, df = corpus
    got = licenses.scan(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted(
        (str(d), n, k, str(a), str(b), s) for d, (n, k, a, b, s) in ((d, brute.base_licenses(t)) for d, t in docs))
    labels = {r.doc_id: r.labels for r in got}
    assert labels[23] == "cc-by-nc" and labels[22] == "apache,gpl,mit"
    assert all(0 <= r.score <= 1 for r in got)


def test_license_diagonals(spark):
    """A notice with inserted, dropped and changed words is still found."""
    rng = random.Random(3)
    w = licenses.TEMPLATES["mit"][0].split()
    changed = w[:12] + ["really"] + w[12:30] + w[31:50] + ["other"] + w[51:]
    _, df = make(spark, [prose(rng, 50) + " " + " ".join(changed) + " " + prose(rng, 20), " ".join(rng.sample(w, len(w)))])
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[0].labels == "mit" and 0.6 < got[0].score < 1 and got[1].labels == ""


def test_license_notices_in_pieces(spark):
    """Ten words inserted in the middle, a page of text between the halves, the
    halves in the wrong order, and a template shorter than a window."""
    rng = random.Random(4)
    w = licenses.TEMPLATES["mit"][0].split()
    texts = [" ".join([*w[:40], *prose(rng, 10).split(), *w[40:]]), " ".join([*w[:40], *prose(rng, 60).split(), *w[40:]]),
             " ".join([*w[:40], *prose(rng, 400).split(), *w[40:]]), " ".join([*w[45:], *prose(rng, 10).split(), *w[:40]]),
             prose(rng, 20) + " All rights reserved. " + prose(rng, 20), "All rights reserved.", "all rights\nRESERVED", "all rights"]
    _, df = make(spark, texts)
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got == {0: "mit", 1: "mit", 2: "", 3: "", 4: "proprietary", 5: "proprietary", 6: "proprietary", 7: ""}


def test_hosts(spark):
    urls = ["http://WWW.Example.com/en/1?x#y", "https://example.com/en/2", "http://a.net/es/3", "http://a.net/de/4", None, "nourl",
            "x://net/fr/", "http://com", "http://evilexample.com/en/5", "ftp://b.org?/en/#://c.net/es/", "http://a.org/p#://z/", "http://c.com/a"]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in hosts.judge(pages, hosts.labelled_outcomes(labels), hosts.page_document(F.col("url"))).collect()}
    assert len(rows) == len(urls)
    assert [(rows[i].host, rows[i].path) for i in (0, 4, 5, 9)] == [("www.example.com", "/en/1"), ("", ""), ("", ""), ("b.org", "")]
    assert [(rows[i].rule, rows[i].verdict) for i in (0, 1, 2, 6)] == [
        ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), ("net/fr/", "block")]
    assert rows[3].rule is None and rows[7].rule is None and rows[8].rule == "com/"


def test_host_posterior(spark):
    """A host of bad pages is blocked, its neighbours are not."""
    rows, labels = [], []
    for h in range(30):
        for _ in range(20):
            n = len(rows)
            rows.append((n, f"http://h{h}.d{h % 5}.org/{n}"))
            labels.append((n, 0 if h == 3 else int(n % 19 > 0), 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = hosts.judge(pages, hosts.labelled_outcomes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
                      hosts.page_document(F.col("url"))).collect()
    assert {r.host for r in out if r.verdict == "block"} == {"h3.d3.org"}


def test_host_levels(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.y.example.com",), ("me.github.io",), ("",), ("com",)], "host string")
    got = {r.host: (r.d, r.s) for r in df.select("host", *[c.alias(n) for c, n in zip(hosts.levels(F.col("host")), "ds")]).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
                   "x.y.example.com": ("example.com", "com"), "me.github.io": ("me.github.io", "github.io"), "": ("", ""), "com": ("com", "com")}


def test_hosts_are_blocked_on_the_tables(spark):
    """The posterior decides pages that no rule judges; other hosts stay."""
    sf = "/root/testdata/check_s"
    out = hosts.judge(spark.read.parquet(f"{sf}/pages.parquet"), hosts.labelled_outcomes(spark.read.parquet(f"{sf}/labels.parquet")),
                      hosts.page_document(F.col("url"))).where("rule is null")
    got = {r.verdict: (r.hosts, r.k) for r in out.groupBy("verdict").agg(F.countDistinct("host").alias("hosts"), F.count("*").alias("k")).collect()}
    assert 0 < got["block"][0] < got["allow"][0] and 0 < got["block"][1] < got["allow"][1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], EMPTY)
    bench = spark.createDataFrame([], "item_id long, text string")
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (paragraphs.repeated_passages(df), quality.quality(df), pii.personal_data(df), fmindex.contamination(df, bench),
                lines.apply_bitmaps(df, lines.dedup_lines(df)), neardup.near_duplicates(df), bpe.encode_digest(df, vocabulary_path()),
                licenses.scan(df), chat.read_back(chat.format_paths(chat.chosen_paths(chat.chains(conv)))),
                hosts.judge(pages, hosts.labelled_outcomes(labels), hosts.page_document(F.col("url")))):
        assert out.count() == 0


def test_empty_benchmark(spark, corpus):
    docs, df = corpus
    bench = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.contamination(df, bench).where("n_hit > 0").count() == 0
