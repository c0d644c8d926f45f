"""License scans: exact set-similarity join of text blocks with license templates.

A block matches a template when it holds at least ``threshold`` of the template's distinct words. Blocks are lines of
any length and, for notices that are wrapped, all runs of as many consecutive words as the template has. Words are ordered by their frequency over all blocks, rarest first. A match must share one of the template's first
``size - need + 1`` words, so only those are joined (prefix filter); blocks with fewer template words than needed leave
first (length filter), and a shared word leaves too few behind it where it stands late in either order (position
filter). What remains is verified exactly: no match is lost. Runs are looked at around words of the prefixes only, in
documents that hold enough of a template's words at all.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountscope.llm.common import let, or_empty
from accountscope.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that name a license wherever their words stand side by side.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Sentences of common license notices, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "Licensed under CC BY-SA 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.85


def tokens(text: Column) -> Column:
    """Words of letters, digits and anything beyond ASCII, with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), WORD_GAPS), "")


def words_of(text: str) -> list[str]:
    """The words of a template, in its order."""
    return [w for w in re.split(WORD_GAPS, text.lower()) if w]


def template_words(text: str) -> list[str]:
    return sorted(set(words_of(text)))


def phrase_places(ws: Column) -> Column:
    """Array of ``struct(start, label)``: every place where a phrase's words stand consecutively."""

    def ends(i: Column) -> Column:
        labels = []
        for phrase, label in PHRASES.items():
            parts = phrase.split(" ")
            hit = i >= len(parts) - 1
            for back, part in enumerate(reversed(parts)):
                hit = hit & (F.get(ws, i - back) == part)
            labels.append(F.when(hit, F.struct((i - (len(parts) - 1)).alias("start"), F.lit(label).alias("label"))))
        return F.array(*labels)

    last_words = sorted({p.split(" ")[-1] for p in PHRASES})
    at = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(last_words), i)), lambda i: i.isNotNull())
    return F.array_compact(F.flatten(F.transform(at, ends)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None,
         threshold: float = THRESHOLD, block_split: str = "\n") -> DataFrame:
    """One row per document: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    NULL text counts as empty: no words, no labels, score 0. Repeated rows and ids are kept apart. score: 1 for a base
    phrase, else the largest containment found, 0 without a match. Other columns are ignored. A template's words may
    stand in any order within a block; line breaks end lines, not runs.
    """
    sized = [(label, ws, math.ceil(threshold * len(ws) - 1e-9), len(words_of(t))) for label, t in templates or TEMPLATES if (ws := template_words(t))]
    vocabulary = sorted({w for _, ws, _, _ in sized for w in ws})
    least = min(need for _, _, need, _ in sized)
    longest = max(run for _, _, _, run in sized)
    known = F.lit(vocabulary)

    def blocks(text: Column) -> Column:
        found = F.transform(F.split(text, block_split), lambda b: F.array_intersect(tokens(b), known))
        return F.filter(found, lambda b: F.size(b) >= least)

    def known_places(ws: Column) -> Column:
        """Template words with their places, in documents that hold enough words of some template."""
        def enough(held: Column) -> Column:
            out = F.lit(False)
            for _, template, need, _ in sized:
                out = out | (F.size(F.array_intersect(held, F.lit(template))) >= need)
            return out

        places = F.transform(ws, lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word"))))
        return F.when(let(F.array_intersect(ws, known), enough), F.filter(places, lambda p: p.isNotNull())).otherwise(
            F.array().cast("array<struct<at:int,word:string>>"))

    # Texts are read once: what follows needs only the template words of blocks that are long enough.
    some = F.translate("text", _UPPER, _LOWER).rlike("|".join(sorted({p.split(" ")[-1] for p in PHRASES})))
    nowhere = F.array().cast("array<struct<start:int,label:string>>")
    own = docs.select(F.col(id_col).alias("id"), or_empty(text_col).alias("text"))
    narrow = own.select(
        "id",
        let(tokens(F.col("text")), lambda ws: F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.when(some, phrase_places(ws)).otherwise(nowhere).alias("places"),
            known_places(ws).alias("known"),
        )).alias("base"),
        blocks(F.col("text")).alias("blocks"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = materialise(narrow.select("id", "row", "base.*", "blocks"), "licenses")

    # A row per block that can match, its words rarest first.
    block = narrow.select("row", F.posexplode("blocks").alias("block", "ws"))
    seen = narrow.select(F.explode(F.concat(F.flatten("blocks"), F.transform("known", lambda p: p["word"]))).alias("w"))
    counted = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    ordered = [(k, label, sorted(ws, key=rank.get), need, run) for k, (label, ws, need, run) in enumerate(sized)]
    prefixes = [(w, k, label, i, len(ws), need, run, ws) for k, label, ws, need, run in ordered for i, w in enumerate(ws[: len(ws) - need + 1])]
    spark = docs.sparkSession
    index = spark.createDataFrame(
        prefixes, "word string, template int, label string, at int, size int, need int, run int, template_words array<string>")
    ranking = F.lit(sorted(vocabulary, key=rank.get))
    in_order = block.select("row", "block", F.array_intersect(ranking, F.col("ws")).alias("ws"))
    # Broadcast: a row per template prefix word, bounded by the template list.
    pairs = (
        in_order.select("row", "block", "ws", F.posexplode("ws").alias("pos", "word")).join(F.broadcast(index), "word")
        .where(F.least(F.size("ws") - F.col("pos"), F.col("size") - F.col("at")) >= F.col("need") - F.col("at"))
    )
    first = pairs.where(F.get(F.array_intersect("template_words", "ws"), F.lit(0)) == F.col("word"))  # once per pair
    shared = F.size(F.array_intersect("ws", "template_words"))
    in_blocks = first.where(shared >= F.col("need")).select("row", "label", (shared / F.col("size")).alias("share"))

    # Runs over line breaks: around every prefix word, the template words less than the longest template away.
    anchors = sorted({w for w, *_ in prefixes})
    around = F.transform("known", lambda p, i: F.when(p["word"].isin(anchors), F.struct(
        p["at"].alias("here"), p["word"].alias("word"),
        F.filter(F.slice("known", F.greatest(i + 2 - longest, F.lit(1)), 2 * longest - 1), lambda q: F.abs(q["at"] - p["at"]) < longest).alias("near"))))
    anchored = narrow.where(F.size("known") > 0).select("row", F.explode(F.filter(around, lambda a: a.isNotNull())).alias("a")).select("row", "a.*")
    own = F.filter("near", lambda q: F.array_contains("template_words", q["word"]) & (F.abs(q["at"] - F.col("here")) < F.col("run")))
    rarer = F.slice("template_words", 1, F.col("at"))
    distinct = F.array_distinct(F.transform("own", lambda q: q["word"]))
    behind = F.size(F.array_except(distinct, rarer))
    likely = anchored.join(F.broadcast(index), "word").withColumn("own", own).where(
        (F.size(distinct) >= F.col("need")) & (behind >= F.col("need") - F.col("at")))
    # A run that holds the anchor can be moved to begin at one of the template's words.
    begins = F.filter("own", lambda q: q["at"] <= F.col("here"))
    held = F.transform(begins, lambda b: F.size(F.array_distinct(F.transform(
        F.filter("own", lambda q: (q["at"] >= b["at"]) & (q["at"] < b["at"] + F.col("run"))), lambda q: q["word"]))))
    in_runs = likely.withColumn("most", F.array_max(held)).where("most >= need").select("row", "label", (F.col("most") / F.col("size")).alias("share"))
    matched = in_blocks.unionByName(in_runs).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("contained"))

    starts = F.transform("places", lambda p: p["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>"))))
    return narrow.drop("blocks", "known").join(matched, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
