"""Linking of near-equal items through shared buckets, without all pairs.

Items are classes of equal content with an id ``cid`` and a size ``n``; bands
are rows (cid, n, h). First every item is compared with one hub, of a bucket it
shares; the pairs are verified exactly and what is linked is joined to
components. Buckets whose items are in one component by then are done. In the last step
the items of the other buckets that stand outside the bucket's largest
component are compared with items of other components there, so no link
between components is lost. Which of them can be linked at all is told by
prefixes: with the tokens of every item ordered from the rarest to the most
frequent, two items that share enough tokens share one among the first few of
each. This test is exact, and so is the one beside it: the bits in which two
bitmaps of tokens differ are at most as many as the tokens of one set alone. Near copies whose changes are their own have only own
tokens there, so a large group of them makes few pairs and not their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstate.llm.common import stored


def size_fits(a: Column, b: Column, percent: int) -> Column:
    """Whether two sets of these sizes can be that similar."""
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, n, bits, t, pos): the rarest tokens of each set of (cid, set), as many as
    a pair of that similarity can need. ``pos`` is the place of token ``t`` in
    the order of its set; tokens of one set only come first and are left out.
    ``bits`` has the parity of the number of tokens with each value of 6 bits."""
    one = F.lit(1).cast("long")
    bits = F.aggregate("set", F.lit(0).cast("long"), lambda b, t: b.bitwiseXOR(
        F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63)).cast("int"))))
    tokens = sets.select("cid", F.explode("set").alias("t"))
    held = stored(tokens.groupBy("t").agg(F.count("*").alias("k")).where("k > 1"), "held")
    common = tokens.join(held, "t").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("ts"))
    ranked = common.join(sets.select("cid", F.size("set").cast("long").alias("n"), bits.alias("bits")), "cid").withColumn("own", F.col("n") - F.size("ts"))
    length = F.greatest(F.lit(0), F.floor(F.col("n") * (100 - percent) / 100) + 1 - F.col("own")).cast("int")
    return (ranked.select("cid", "n", "bits", "own", F.posexplode(F.slice("ts", F.lit(1), length)).alias("i", "x"))
            .select("cid", "n", "bits", F.col("x.t").alias("t"), (F.col("own") + F.col("i")).alias("pos")))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .where("up > 1 or (up = 1 and down = 1)").isEmpty())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the edges (a, b); ``comp`` is the smallest
    node of the component. Alternates large-star and small-star steps, each a
    partial aggregate and a join, until only stars are left."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def pruned_components(edges: DataFrame) -> DataFrame:
    """As ``components``, for graphs where most nodes have a single edge, as the
    copies around a hub have. Such ends are set aside by one aggregate, the
    steps run over what is left, and the ends take the label of their centre."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    ends = (both.groupBy("u").agg(F.count("*").alias("k"), F.min("v").alias("v")).where("k = 1")
            .select(F.col("u").alias("end"), F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    # an edge between two ends is a component of its own, with the smaller as its centre
    ends = ends.groupBy("u", "v").agg(F.max("end").alias("end"))
    ends = stored(ends.withColumn("centre", F.when(F.col("end") == F.col("u"), F.col("v")).otherwise(F.col("u"))), "ends")
    core = components(e.join(ends.select("u", "v"), ["u", "v"], "left_anti").select(F.col("u").alias("a"), F.col("v").alias("b")))
    core = stored(core, "core")
    centres = (ends.groupBy("centre").agg(F.min("end").alias("low")).join(core, F.col("centre") == F.col("node"), "left")
               .select("centre", "low", F.col("node").isNull().alias("bare"), F.coalesce("comp", "centre").alias("comp")))
    centres = stored(centres, "centres")
    # the smallest node of a component can be one of its ends
    least = centres.groupBy("comp").agg(F.min("low").alias("low"))
    inner = core.join(least, "comp", "left").select("node", F.least("comp", "low").alias("comp"))
    outer = centres.drop("low").join(least, "comp").select("centre", "bare", F.least("comp", "low").alias("comp"))
    return (inner.unionByName(outer.where("bare").select(F.col("centre").alias("node"), "comp"))
            .unionByName(ends.select("end", "centre").join(outer, "centre").select(F.col("end").alias("node"), "comp")))


def shared_buckets(bands: DataFrame) -> DataFrame:
    """Rows (h, cid, n, k) of the buckets with two items or more; ``k`` is how
    many."""
    # dealt out once, for the aggregate and for the join
    bands = bands.repartition("h")
    shared = (bands.groupBy("h").agg(F.min("cid").alias("low"), F.max("cid").alias("top"), F.count("*").alias("k"))
              .where("low < top").select("h", "k"))
    return stored(bands.join(shared, "h"), "buckets")


def link(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], percent: int,
         sets_of: Callable[[DataFrame], DataFrame], group: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """(node, comp) of every item that has a link. ``verify`` takes pairs (a, b)
    and returns those that are linked; ``sets_of`` takes rows (cid) and returns
    the distinct tokens (cid, set) of these items; ``group`` makes components of
    the links to hubs."""
    # an item that meets many others, such as the origin of many copies, makes the best hub
    met = shared.join(shared.groupBy("cid").agg(F.sum("k").alias("met")), "cid").select("h", "cid", "n", "met")
    met = stored(met, "met")
    hubs = met.groupBy("h").agg(F.max(F.struct("met", F.xxhash64("cid").alias("x"), "cid", "n")).alias("hub"))
    near = met.join(hubs, "h").where((F.col("cid") != F.col("hub.cid")) & size_fits(F.col("n"), F.col("hub.n"), percent))
    tested = stored(near.groupBy("cid").agg(F.max("hub").alias("hub"))
                    .select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct(), "pairs")
    links = stored(verify(tested), "links")
    labels = stored(group(links), "labels")
    rows = stored(met.join(labels, F.col("cid") == F.col("node"), "left").select(
        "h", "cid", "n", F.coalesce("comp", "cid").alias("comp")), "open")
    sizes = rows.groupBy("h", "comp").agg(F.count("*").alias("k"))
    major = sizes.groupBy("h").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("parts")).where(
        "parts > 1").select("h", F.col("m.comp").alias("major"))
    # the open buckets of an item are at most as many as it has bands
    items = stored(rows.join(major, "h").groupBy("cid").agg(
        F.min("comp").alias("comp"), F.collect_set("h").alias("hs"), F.max(F.col("comp") != F.col("major")).alias("minor")), "open")
    sets = stored(sets_of(items.select("cid")), "sets")
    heads = stored(prefixes(sets, percent).join(items.drop("hs"), "cid"), "prefixes")
    other = heads.where("minor").select("t", *[F.col(c).alias(f"x_{c}") for c in ("cid", "n", "comp", "pos", "bits")])
    least = percent * (F.col("n") + F.col("x_n"))
    possible = ((F.col("comp") != F.col("x_comp")) & size_fits(F.col("n"), F.col("x_n"), percent)
                # two minor items meet once
                & (~F.col("minor") | (F.col("cid") < F.col("x_cid")))
                # tokens from the shared one on are enough for the pair
                & ((100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("x_n") - F.col("x_pos")) >= least)
                # every token of one set alone changes one bit
                & ((100 + percent) * F.bit_count(F.col("bits").bitwiseXOR(F.col("x_bits"))) <= (100 - percent) * (F.col("n") + F.col("x_n"))))
    pairs = (heads.withColumnRenamed("t", "t2").join(other, (F.col("t2") == F.col("t")) & possible)
             .select(F.least("cid", "x_cid").alias("a"), F.greatest("cid", "x_cid").alias("b"),
                     F.least("comp", "x_comp").alias("u"), F.greatest("comp", "x_comp").alias("v")).distinct())
    buckets = [items.select(F.col("cid").alias(c), F.col("hs").alias(f"h{c}")) for c in ("a", "b")]
    pairs = pairs.join(buckets[0], "a").join(buckets[1], "b").where(F.arrays_overlap("ha", "hb")).drop("ha", "hb")
    pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    found = stored(verify(pairs.select("a", "b")).join(pairs, ["a", "b"]).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "links")
    if found.isEmpty():
        return labels
    # the components found so far are the nodes of what is left to join
    merged = stored(components(found), "merged")
    roots = merged.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    return (labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
            .unionByName(merged.join(labels, "node", "left_anti")))
