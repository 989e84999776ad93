"""Merkle manifest of a dataset with octopus multiproofs (operator 11).

Every row is a leaf, every source a tree of fan-out three over its leaves in
the order of doc_id, and the roots of the trees are the leaves of one top tree.

*Building.* Leaves get their place by range partitioning, so a source that
holds most rows spreads over many tasks. Nodes are made in tiers: one shuffle
deals out aligned stretches of 3^7 nodes, and a task turns each stretch into
the seven levels above it. A tree of n leaves takes log(n) / log(2187) shuffles.

*Proving.* The leaves to prove are dealt out in partitions of ``BLOCK`` places
of one tree. Each partition works out which node coordinates it cannot derive
from its own leaves (the octopus: per level the members of the touched runs
less the known ones, up to the root of the top tree), all these requests are
fetched by one join, and the partition derives the shared interior nodes once
and expands the proof of each of its leaves from the suffix of its parent.

Defined results: a null field is hashed as ``-``, so null and empty differ;
rows without a doc_id come first in their source; rows that share a doc_id
stand in the order of their digests, equal rows are leaves of their own; a null
source is a tree of its own that comes first; very long texts are hashed in the
JVM and never reach Python; an empty table gives no rows; columns of any other
name are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstate.llm.common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, TIER, BLOCK = 3, 7, 4096
TOP = ""

NODES = "tree string, level int, idx long, n long, digest string"
COORDINATES = "tree string, block long, of string, level int, idx long"
PROOFS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """sha256 of the fields, each with its length in bytes in front."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``, the place inside ``tree``, and ``n``, the size of it."""
    ranged = stored(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                    .withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranged")
    runs = ranged.groupBy("tree", "pid").agg(F.count("*").alias("k"), F.min("at").alias("low"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "pid", "low", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("first"),
                       F.sum("k").over(tree).alias("n"))
    return (ranged.join(runs, ["tree", "pid"])
            .withColumn("idx", F.col("first") + F.col("at") - F.col("low")).drop("pid", "at", "low", "first"))


# ------------------------------------------------------------------ building

def _stretches(base: int):
    """Nodes of the levels above stretches of nodes of level ``base``."""

    def levels(tree: str, chunk: int, n: int, nodes: list[str]) -> Iterator[tuple]:
        first = chunk * FAN**TIER
        for level in range(base + 1, base + TIER + 1):
            if n == 1:
                return
            nodes = [digest("".join(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]
            first, n = first // FAN, -(-n // FAN)
            for i, node in enumerate(nodes):
                yield tree, level, first + i, n, node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, nodes, out = None, 0, [], []
        for batch in batches:
            for tree, chunk, n, node in zip(*(batch.column(c).to_pylist() for c in ("tree", "chunk", "n", "digest")), strict=True):
                if key != (tree, chunk):
                    if nodes:
                        out.extend(levels(*key, size, nodes))
                    key, size, nodes = (tree, chunk), n, []
                nodes.append(node)
            if len(out) > 10_000:
                yield _batch(out, NODES)
                out = []
        if nodes:
            out.extend(levels(*key, size, nodes))
        if out:
            yield _batch(out, NODES)
    return run


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _schema(spec: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in spec.split(", "))])


def _batch(rows: list[tuple], spec: str) -> pa.RecordBatch:
    schema = _schema(spec)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def interior(leaves: DataFrame) -> DataFrame:
    """(tree, level, idx, n, digest) of all nodes above the leaves (tree, idx,
    n, digest); ``n`` is how many nodes the level has in its tree."""
    rows, base, made = leaves.select("tree", "idx", "n", "digest"), 0, []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        chunk = F.floor(F.col("idx") / F.lit(FAN**TIER)).cast("long")
        level = stored(rows.where("n > 1").withColumn("chunk", chunk).repartition("tree", "chunk")
                       .sortWithinPartitions("tree", "chunk", "idx").mapInArrow(_stretches(base), NODES), "nodes")
        made.append(level)
        base, most = base + TIER, -(-most // FAN**TIER)
        if most <= 1:
            break
        rows = level.where(F.col("level") == base).select("tree", "idx", "n", "digest")
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def manifest(docs: DataFrame, claimed_text: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, tops, nodes) of a table. ``leaves`` (tree, idx, n, doc_id, digest,
    claim) are its rows, where ``claim`` is the digest with ``claimed_text`` in
    the place of the text if it differs; ``tops`` (tree, idx, n, digest) are the
    roots of the sources; ``nodes`` (of, level, idx, digest) are all nodes."""
    fields = [F.col(c) for c in FIELDS]
    changed = F.lit(None).cast("string") if claimed_text is None else leaf_digest(fields[:-1] + [claimed_text])
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).alias("tree"), "doc_id",
                       leaf_digest(fields).alias("digest"), changed.alias("claim"))
    rows = rows.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim")))
    leaves = stored(numbered(rows, "doc_id", "digest"), "leaves")
    above = interior(leaves)
    roots = above.where("n = 1").select("tree", "digest").unionByName(leaves.where("n = 1").select("tree", "digest"))
    tops = numbered(roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("sub"), "digest"), "sub")
    tops = stored(tops, "tops")
    ground = [x.select("tree", F.lit(0).alias("level"), "idx", "digest") for x in (leaves, tops)]
    nodes = [x.select("tree", "level", "idx", "digest") for x in (above, interior(tops))]
    every = ground[0].unionByName(ground[1]).unionByName(nodes[0]).unionByName(nodes[1])
    return leaves, tops.select(F.col("sub").alias("tree"), "idx", "n", "digest"), every.withColumnRenamed("tree", "of")


# ------------------------------------------------------------------- proving

def missing(at: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, known, missing) up to the root of a tree of ``n`` leaves of which
    those at the sorted places ``at`` are known."""
    level = 0
    while n > 1:
        runs = np.unique(at // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        members = members[members < n]
        yield level, at, np.setdiff1d(members, at, assume_unique=True)
        at, n, level = runs, -(-n // FAN), level + 1


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for tree, block, at, n, place, n_top in zip(*(batch.column(c).to_pylist() for c in (
                "tree", "block", "at", "n", "place", "n_top")), strict=True):
            for of, known, size in ((tree, np.unique(at), n), (TOP, np.array([place]), n_top)):
                for level, _, absent in missing(known, size):
                    out.extend((tree, block, of, level, i) for i in absent.tolist())
        yield _batch(out, COORDINATES)


class _Tree:
    """The part of a tree that a partition knows or derives."""

    def __init__(self, at: np.ndarray, n: int, leaves: dict, fetched: dict):
        self.n, self.levels, self.nodes = n, [], []
        nodes = dict(leaves)
        for level, known, _ in missing(at, n):
            nodes.update(fetched.get(level, {}))
            self.levels.append(known.tolist())
            self.nodes.append(nodes)
            nodes = {r: digest("".join(self.run(level, r))) for r in np.unique(known // FAN).tolist()}
        self.root = nodes[0]

    def run(self, level: int, r: int, skip: int = -1) -> list[str]:
        nodes = self.nodes[level]
        return [nodes[i] for i in range(r * FAN, r * FAN + FAN) if i in nodes and i != skip]

    def proofs(self, above: str) -> dict[int, str]:
        """Siblings of each known leaf, level by level, then those ``above``."""
        suffix = {0: above}
        for level in range(len(self.levels) - 1, -1, -1):
            suffix = {i: "".join(self.run(level, i // FAN, i)) + suffix[i // FAN] for i in self.levels[level]}
        return suffix

    def fold(self, i: int, leaf: str) -> str:
        """Root that the siblings of place ``i`` give with another leaf."""
        for level in range(len(self.levels)):
            r = i // FAN
            leaf = digest("".join(leaf if j == i else self.nodes[level][j]
                                  for j in range(r * FAN, r * FAN + FAN) if j in self.nodes[level]))
            i = r
        return leaf


def _expand(left: pa.Table, right: pa.Table) -> pa.Table:
    """Proofs of the leaves of one partition from the nodes it fetched."""
    idx = left.column("idx").to_numpy()
    tree = left.column("tree")[0].as_py() if len(idx) else None
    fetched: dict = {tree: {}, TOP: {}}
    place = n_top = None
    for of, level, i, node in zip(*(right.column(c).to_pylist() for c in ("of", "level", "idx", "digest")), strict=True):
        if level < 0:
            place, n_top = i, int(node)
        else:
            fetched[of].setdefault(level, {})[i] = node
    rows = []
    if len(idx):
        digests = left.column("digest").to_pylist()
        own = _Tree(np.unique(idx), left.column("n")[0].as_py(), dict(zip(idx.tolist(), digests, strict=True)), fetched[tree])
        top = _Tree(np.array([place]), n_top, {place: own.root}, fetched[TOP])
        proofs = own.proofs(top.proofs("")[place])
        for i, doc, leaf, claim in zip(idx.tolist(), left.column("doc_id").to_pylist(), digests,
                                       left.column("claim").to_pylist(), strict=True):
            folded = top.root if claim is None else top.fold(place, own.fold(i, claim))
            rows.append((doc, leaf, own.root, top.root, digest(proofs[i]), folded, folded == top.root))
    return pa.Table.from_batches([_batch(rows, PROOFS)])


def multiproofs(wanted: DataFrame, tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """One verified proof (``PROOFS``) for each of the wanted leaves, which may
    be any subset of the leaves of a manifest."""
    wanted = wanted.withColumn("block", F.floor(F.col("idx") / F.lit(BLOCK)).cast("long"))
    parts = (wanted.groupBy("tree", "block").agg(F.collect_list("idx").alias("at"), F.first("n").alias("n"))
             .join(tops.select("tree", F.col("idx").alias("place"), F.col("n").alias("n_top")), "tree"))
    parts = stored(parts, "parts")
    requests = parts.mapInArrow(_requests, COORDINATES)
    heads = parts.select("tree", "block", F.lit(TOP).alias("of"), F.lit(-1).alias("level"),
                         F.col("place").alias("idx"), F.col("n_top").cast("string").alias("digest"))
    answers = stored(requests.join(nodes, ["of", "level", "idx"]).select(*heads.columns).unionByName(heads), "answers")
    return (wanted.groupBy("tree", "block").cogroup(answers.groupBy("tree", "block"))
            .applyInArrow(_expand, PROOFS))


def tampered_text() -> Column:
    """The text without line breaks in the documents that are tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
