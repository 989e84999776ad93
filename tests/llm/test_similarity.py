"""Components and links of the near-duplicate operators against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from segstate.llm.paragraphs import similar
from segstate.llm.similarity import components, link, pruned_components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return {x: root(x) for x in parent}


GRAPHS = {
    "empty": [], "loop": [(4, 4)], "one edge": [(9, 2)], "twice": [(2, 9), (9, 2), (2, 9)],
    "star, least in the middle": [(1, x) for x in range(2, 40)],
    "star, least at an end": [(50, x) for x in range(3, 40)] + [(50, -7)],
    "chain": [(x, x + 1) for x in range(30)],
    "stars on a chain": [(100 * i, 100 * i + j) for i in range(5) for j in range(1, 9)] + [(100, 200), (200, 300), (400, -5)],
    "ring with ends": [(x, (x + 1) % 6) for x in range(6)] + [(x, 10 * x + 20) for x in range(6)] + [(3, -1)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("make", [components, pruned_components])
def test_components_of_small_graphs(spark, name, make):
    rows = make(spark.createDataFrame(GRAPHS[name], "a long, b long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["comp"] for r in rows} == brute(GRAPHS[name])


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(320)]
    got = {r["node"]: r["comp"] for r in pruned_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_link_loses_no_link_between_components(spark):
    """Many short sets that share tokens, buckets by the least of three orders."""
    rng = random.Random(8)
    sets = {}
    for g in range(12):
        base = rng.sample(range(60), 12)
        for _ in range(8):
            kept = frozenset(x for x in base if rng.random() < 0.9) | {rng.randrange(60)}
            sets[kept] = len(sets)
    sets = {i: sorted(s) for i, s in enumerate(sets)}
    orders = [rng.sample(range(60), 60) for _ in range(3)]
    bands = [(b * 1000 + min(o[x] for x in s), i) for i, s in sets.items() for b, o in enumerate(orders)]
    of_bucket = {}
    for h, i in bands:
        of_bucket.setdefault(h, []).append(i)
    edges = [(a, b) for ids in of_bucket.values() for a in ids for b in ids
             if a < b and 175 * len(set(sets[a]) & set(sets[b])) >= 75 * (len(sets[a]) + len(sets[b]))]
    assert len(edges) > 20
    content = spark.createDataFrame([(i, s) for i, s in sets.items()], "cid long, set array<long>")
    shared = spark.createDataFrame([(h, i, len(sets[i]), len(of_bucket[h])) for h, i in bands if len(of_bucket[h]) > 1],
                                   "h long, cid long, n long, k long")

    def verify(pairs):
        a, b = (content.select(F.col("cid").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").where(similar(F.col("sa"), F.col("sb"))).select("a", "b")

    for more in ({}, {"group": pruned_components}):
        got = link(shared, verify, 75, lambda wanted: content.join(wanted, "cid"), **more).collect()
        assert {r["node"]: r["comp"] for r in got} == brute(edges)
