"""License scan by diagonal voting (operator 10).

Every document is a sequence of lower-case words. The rolling hashes of all
its ``K``-word windows are joined to the positions of the same windows in the
templates. Each match votes for the diagonal (document position less template
position) of its template; votes are aggregated per diagonal, and diagonals that
lie within ``GAP`` words of each other (inserted or dropped words) are merged to
runs. Runs of one template that follow each other in the document and in the
template, at most a template's length apart, are one notice with longer
insertions or gaps. The span of a notice is verified: the share of template words
that its votes cover must reach ``MIN_SHARE``. Templates of fewer than ``K`` words
are one window of their own length.

The templates are fixed texts, so the table of their windows has a fixed size
and is broadcast; windows that no template has are dropped where they are
hashed, which is the same join done early.

Defined results: null text is empty and has no words; each row gets a row, repeated
or not; a document without a match has empty labels and score 0; labels are a
set, so ties add nothing; very long texts are read in blocks; an empty table
gives no rows; columns of any other name are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segstate.llm import textarrays as T
from segstate.llm.common import stored

K, GAP, MIN_SHARE = 4, 4, 0.75

# Phrases of the base rule with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Wording of public licenses and notices.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        " an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: Redistributions of source code must retain the above copyright notice, this"
        " list of conditions and the following disclaimer.",
        "Licensed under the BSD License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0."],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced", "All rights reserved."],
}


def _template_rows() -> list[tuple[str, int, int, int, int]]:
    """(label, template, words, position, hash) of every template window."""
    rows = []
    for label, group in TEMPLATES.items():
        for n, text in enumerate(group):
            w = T.Words(next(T.blocks(pa.array([text]))), T.ALNUM, True)
            sh, at, _ = T.shingles(w.hash, w.offsets, K, True)
            rows += [(label, n, int(w.counts[0]), int(a), int(h)) for a, h in zip(at, T.signed(sh), strict=True)]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_template_rows(), "label string, template int, t_words int, t_pos int, h long")


def _phrase_hashes() -> list[tuple[list[int], str]]:
    out = []
    for phrase, label in PHRASES:
        w = T.Words(next(T.blocks(pa.array([phrase]))), T.ALNUM, True)
        out.append((list(w.hash), label))
    return out


SCANNED = ("doc_id long, rid long, n_words long, n_base long, first_word long, last_word long, base array<string>,"
           " hits array<struct<pos:long,h:long>>")


def _scanner(wanted: dict[int, int]):
    """``wanted``: hashes of the template windows with their widths."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.unique(np.array(list(wanted), dtype=np.int64)).view(np.uint64)
        keys.sort()
        widths = sorted(set(wanted.values()))
        table = np.zeros(1 << 16, dtype=bool)
        table[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        phrases = _phrase_hashes()
        for batch in batches:
            for block in T.blocks(batch.column("text")):
                w = T.Words(block, T.ALNUM, True)
                n = len(w.hash)
                doc = w.doc()
                places, kinds = [], []
                for hashes, label in phrases:
                    k = len(hashes)
                    at = np.flatnonzero(w.hash[:n - k + 1] == hashes[0]) if n >= k else np.zeros(0, np.int64)
                    for j in range(1, k):
                        at = at[w.hash[at + j] == hashes[j]]
                    at = at[doc[at] == doc[at + k - 1]]
                    places.append(at)
                    kinds += [label] * len(at)
                place = np.concatenate(places)
                owner, kinds = doc[place], np.array(kinds, dtype=object)
                rel = place - w.offsets[owner]
                hits = []
                for k in widths:
                    sh, at, wins = T.shingles(w.hash, w.offsets, k, False)
                    some = np.flatnonzero(table[(sh & np.uint64(0xFFFF)).astype(np.int64)])
                    some = some[np.isin(sh[some], keys)]
                    hits.append((np.searchsorted(np.cumsum(wins), some, "right"), at[some], sh[some]))
                hit_doc, hit_pos, hit = (np.concatenate(x) for x in zip(*hits, strict=True))
                order = np.argsort(hit_doc, kind="stable")
                hit_doc, hit_pos, hit = hit_doc[order], hit_pos[order] - w.offsets[hit_doc[order]], T.signed(hit[order])
                cuts = np.searchsorted(hit_doc, np.arange(block.n + 1))
                rows = []
                found = set(owner.tolist())
                for i in range(block.n):
                    mine = rel[owner == i] if i in found else None
                    rows.append((
                        0 if mine is None else len(mine), None if mine is None else int(mine.min()),
                        None if mine is None else int(mine.max()),
                        [] if mine is None else sorted(set(kinds[owner == i])),
                        [{"pos": int(hit_pos[j]), "h": int(hit[j])} for j in range(cuts[i], cuts[i + 1])]))
                c = list(zip(*rows, strict=True))
                part = slice(block.first, block.first + block.n)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[part], batch.column("rid")[part], pa.array(w.counts),
                    pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()),
                    pa.array(c[3], pa.list_(pa.string())),
                    pa.array(c[4], pa.list_(pa.struct([("pos", pa.int64()), ("h", pa.int64())])))],
                    names=["doc_id", "rid", "n_words", "n_base", "first_word", "last_word", "base", "hits"])
    return scan


def spans(scanned: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(rid, label, start, end, share): verified license spans, ends exclusive."""
    spark = scanned.sparkSession
    votes = (scanned.where(F.size("hits") > 0).select("rid", F.explode("hits").alias("hit"))
             .select("rid", "hit.pos", "hit.h")
             .join(F.broadcast(templates(spark)), "h")
             .withColumn("diagonal", F.col("pos") - F.col("t_pos"))
             # a template shorter than K words is one window
             .withColumn("width", F.least(F.col("t_words"), F.lit(K)))
             .withColumn("covers", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.col("t_pos") + j)))
    diagonals = votes.groupBy("rid", "label", "template", "t_words", "diagonal").agg(
        F.array_distinct(F.flatten(F.collect_list("covers"))).alias("covers"),
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("width")).alias("end"))
    near = Window.partitionBy("rid", "label", "template").orderBy("diagonal")
    runs = (diagonals.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(near) > GAP).cast("int"))
            .withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(near)))
    one = Window.partitionBy("rid", "label", "template").orderBy("start", "end", "run")
    joined = runs.groupBy("rid", "label", "template", "t_words", "run").agg(
        F.array_distinct(F.flatten(F.collect_list("covers"))).alias("covers"), F.min("start").alias("start"), F.max("end").alias("end"))
    # a notice goes on while the template does
    follows = ((F.col("start") - F.lag("end").over(one) <= F.col("t_words"))
               & (F.array_min("covers") >= F.lag(F.array_min("covers")).over(one))
               & (F.array_max("covers") > F.lag(F.array_max("covers")).over(one)))
    notices = joined.withColumn("notice", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(one))
    merged = notices.groupBy("rid", "label", "template", "t_words", "notice").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covers")))).alias("n"),
        F.min("start").alias("start"), F.max("end").alias("end"))
    share = F.round(F.col("n") / F.col("t_words"), 6)
    return merged.withColumn("share", share).where(F.col("share") >= min_share).select(
        "rid", "label", "start", "end", "share")


def scan(docs: DataFrame) -> DataFrame:
    """Base places, labels and score of every document."""
    spark = docs.sparkSession
    wanted = {h: min(words, K) for _, _, words, _, h in _template_rows()}
    # the id is fixed by writing it, together with what is measured
    seen = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")
                  .mapInArrow(_scanner(wanted), SCANNED), "licenses")
    best = spans(seen).groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    base = F.col("base")
    return (seen.drop("hits").join(best, "rid", "left")
            .select("doc_id", "n_words", "n_base", "first_word", "last_word",
                    F.array_join(base, ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",")
                    .alias("labels"),
                    F.greatest(F.coalesce("share", F.lit(0.0)),
                               F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score")))
