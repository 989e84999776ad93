"""Chat formatting of reply trees (operator 8).

Messages form trees by (tree, node, parent). Self-joins that double the reach
in each round give every node its ancestors at distances 1, 2, 4, ... and the
sum of scores down to it, so a path of n messages takes log2(n) rounds. The
leaves of a tree are ranked by the mean score of their root-to-leaf path, the
best ``branches`` of them are chosen, and the ancestor tables, read from the
longest to the shortest step, list the messages of each chosen path. Paths are
dealt out by path and sorted by depth; one streaming pass writes them turn by
turn in parts of bounded size, so a path of any length never stands in memory.

Template of a turn: ``<s>[role]\\n`` text ``</s>\\n``. Inside roles and texts a
backslash goes before each backslash, ``<``, ``[`` and ``]``, so no control
string can stand there, and dropping it again gives the text back.

Defined results: null text and null role are empty; a message whose parent is
missing (or null, or itself) is a root; nodes that lie on a cycle belong to no
path; repeated rows (same tree and node) count once, the least row wins; rows
with a null tree id are one tree; a null node is no message; ties in score go to the
smaller leaf; a text of any length is one turn, written and read as a whole; an
empty table gives no rows; columns of any other name are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segstate.llm.common import stored

PART_CHARS = 1 << 20
ESCAPED = re.compile(r"[\\<\[\]]")
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"<s>\[((?:[^\\\]]|\\.)*)\]\n((?:[^\\<]|\\.)*)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: each row replies to the one before it
    by (turn, role, text). Repeated rows stay turns of their own."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (conversations.select("conv_id", "turn", "role", "text")
            .withColumn("node", F.row_number().over(w).cast("long"))
            .select(F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text",
                    F.lit(0.0).alias("score")))


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, role, text) of the messages of the chosen paths."""
    kind = messages.schema["tree"].dataType
    # a key that joins on null as well
    key = F.coalesce(F.concat(F.lit("1"), F.col("tree").cast("string")), F.lit("0"))
    nodes = stored(messages.select(key.alias("tree"), "node", "parent", "role", "text",
                                   F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
                   .where("node is not null")
                   .groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
                   .select("tree", "node", "m.*"), "messages")
    parents = nodes.select("tree", F.col("node").alias("anc"), F.lit(True).alias("there"))
    links = nodes.select("tree", "node", F.col("parent").alias("anc"), "score").where("anc <> node")
    # up: the ancestor 2^k steps above; total, depth: over the path walked so far
    walk = (nodes.select("tree", "node", "score")
            .join(links.join(parents, ["tree", "anc"], "left_semi").drop("score"), ["tree", "node"], "left")
            .select("tree", "node", F.col("anc").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")))
    steps, n_nodes = [], None
    while True:
        walk = stored(walk, "walk")
        steps.append(walk.where("up is not null").select("tree", "node", "up"))
        n_nodes = nodes.count() if n_nodes is None else n_nodes
        if steps[-1].isEmpty() or 2 ** len(steps) > 2 * n_nodes + 2:
            break
        above = walk.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"),
                            F.col("total").alias("t2"), F.col("depth").alias("d2"))
        # nodes that have reached their root are not joined again
        further = (walk.where("up is not null").join(above, ["tree", "up"])
                   .select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"),
                           (F.col("depth") + F.col("d2")).alias("depth")))
        walk = walk.where("up is null").unionByName(further)
    rooted = walk.where("up is null").select("tree", "node", "total", "depth")
    leaves = rooted.join(links.select("tree", F.col("anc").alias("node")), ["tree", "node"], "left_anti")
    by_score = Window.partitionBy("tree").orderBy(F.col("mean").desc(), "node")
    best = (leaves.withColumn("mean", F.col("total") / F.col("depth"))
            .withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= branches)
            .select("tree", F.col("node").alias("leaf"), "rank", "node"))
    path = stored(best, "path")
    for step in reversed(steps):
        if step.isEmpty():
            continue
        path = stored(path.unionByName(path.join(step, ["tree", "node"]).drop("node").withColumnRenamed("up", "node")), "path")
    return (path.join(rooted.select("tree", "node", "depth"), ["tree", "node"])
            .join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
            .select(F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 20)).cast(kind).alias("tree"),
                    "leaf", "rank", "depth", "role", "text"))


FORMATTED = "tree long, leaf long, part long, formatted string, loss array<struct<start:long,end:long>>"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by path and depth to formatted parts of whole turns. ``loss``
    lists the code points of a part that an assistant wrote."""
    key, part, held, size, loss = None, 0, [], 0, []

    def flush():
        return pa.RecordBatch.from_pylist(
            [{"tree": key[0], "leaf": key[1], "part": part, "formatted": "".join(held),
              "loss": [{"start": a, "end": b} for a, b in loss]}], schema=schema)

    schema = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()),
                        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if key != (row["tree"], row["leaf"]) or size >= PART_CHARS:
                if held:
                    out.append(flush())
                part = part + 1 if key == (row["tree"], row["leaf"]) else 0
                key, held, size, loss = (row["tree"], row["leaf"]), [], 0, []
            head, body = f"<s>[{escape(row['role'] or '')}]\n", escape(row["text"] or "")
            if row["role"] == "assistant":
                loss.append((size + len(head), size + len(head) + len(body)))
            turn = f"{head}{body}</s>\n"
            held.append(turn)
            size += len(turn)
        yield from out
    if held:
        yield flush()


def format_paths(paths: DataFrame) -> DataFrame:
    """Formatted conversations: the parts of a path, joined in order, are its text."""
    return (paths.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "depth")
            .select("tree", "leaf", "role", "text").mapInArrow(_write, FORMATTED))


DIGEST = ("tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
          " formatted_chars long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted parts back, path by path."""
    state = None

    def done():
        return {"tree": state[0][0], "leaf": state[0][1], "n_turns": state[1], "turns_sha256": state[2].hexdigest(),
                "loss_chars": state[3], "loss_sha256": state[4].hexdigest(), "formatted_chars": state[5]}

    schema = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            key = (row["tree"], row["leaf"])
            if state is None or state[0] != key:
                if state is not None:
                    out.append(done())
                state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["formatted"]
            for turn in TURN.finditer(text):
                state[1] += 1
                state[2].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
            for span in row["loss"]:
                said = unescape(text[span["start"]:span["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([done()], schema=schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted paths, taken from the text itself. The parts of a
    path come in order from ``format_paths``, which keeps its partitions."""
    return formatted.mapInArrow(_read, DIGEST)


def injected(spark: SparkSession) -> DataFrame:
    """The conversation whose texts hold control strings of a common template."""
    return spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                 "conv_id long, turn long, role string, text string")
