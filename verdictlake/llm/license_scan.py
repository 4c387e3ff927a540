"""License scans with an exact set-similarity join, with DataFrame functions only.

Texts are reduced to their words. Phrases are found where their words stand in a
row. Templates, the sentences of license notices, are found by containment: any
`block` words in a row, wherever they begin, belong to a template if they hold at
least `threshold` of the template's words.

Words are ordered by how many documents of the corpus hold them, rare ones first. A
block that reaches the threshold, alpha of the template's m words, must hold one of
its m - alpha + 1 rarest (prefix filter) and at least alpha words of any template
(length filter), and behind their first common word both must have enough left
(positional filter). The filters work on documents first and then around each place
of a template's prefix words; what passes is verified by intersection with every
block there, so nothing that meets the threshold is missed.

Texts are read once: that pass finds the phrases, notes which of the templates' words
a document holds, and keeps the words of a document only where it holds enough of
some template's (length filter of whole documents). The order of the words and the
join then work on what was kept. Templates and their words are fixed by the caller,
not by the data.

Defined results: a null or empty text has no words, no labels and score 0; rows
that repeat doc_id and text get equal results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, text_or_empty

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases, and words of well-known license notices.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ],
    "gpl-3": ["this work is licensed under the gnu general public license version 3"],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at mozilla org"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
BLOCK, THRESHOLD = 64, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words, each after one blank, and a blank at the end; one blank if there are none."""
    return F.concat(F.rtrim(F.regexp_replace(F.concat(F.lit(" "), F.translate(text, UPPER, LOWER)), NOT_WORD, " ")), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(spaced: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places of a phrase, its first and its last start."""
    delim = f" {phrase} "
    n_words = _blanks(spaced) - 1
    has = spaced.contains(delim)
    n = F.when(has, F.size(F.split(spaced, f" {re.escape(phrase)}(?= )")) - 1).otherwise(0)
    first = F.when(has, _blanks(F.substring_index(spaced, delim, 1)))
    last = F.when(has, n_words - _blanks(F.substring_index(spaced, delim, -1)) - len(phrase.split()))
    return n, first, last


def sentences(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, list[str], int]]:
    """(label, words, how many of them a block must hold) of each template."""
    tokens = [(label, list(dict.fromkeys(t.split()))) for label, texts in templates.items() for t in texts]
    return [(label, words, math.ceil(threshold * len(words) - 1e-9)) for label, words in tokens]


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def template_matches(candidates: DataFrame, held: DataFrame, templates: dict[str, list[str]] = TEMPLATES, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h, words) of candidates, (held) vocabulary of every document -> (doc_id, h, start, label, containment).

    A row for the best block around each place of a prefix word from where the
    threshold is met. The best block of a template starts at one of its words: one
    that starts earlier holds no more of them. Per place, at most `block` words before
    and behind it are looked at, so work and memory follow the text's words.
    """
    spark = candidates.sparkSession
    counts = {r["w"]: r["n"] for r in held.select(F.explode("held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # words of the templates alone
    known = sentences(templates, threshold)
    ranked = sorted({w for _, words, _ in known for w in words}, key=lambda w: (counts.get(w, 0), w))
    index = []
    for label, words, need in known:
        tokens = [w for w in ranked if w in words]
        index += [(w, label, i, len(tokens), need, tokens) for i, w in enumerate(tokens[: len(tokens) - need + 1])]
    names = ("word", "label", "at", "m", "need")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r[:5], strict=True)], _words(r[5]).alias("tokens")) for r in index]
    prefixes = spark.range(1).select(F.inline(F.array(*rows)))  # as many rows as the templates have prefix words

    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(ranked))
    of = candidates.select("doc_id", "h", spots.alias("spots"), F.array_intersect(_words(ranked), F.col("words")).alias("held"))  # in corpus order
    each = of.select("*", F.posexplode("held").alias("place", "word"))
    left = F.least(F.col("m") - F.col("at"), F.size("held") - F.col("place"))
    pairs = each.join(F.broadcast(prefixes), "word").where((F.size("held") >= F.col("need")) & (left >= F.col("need")))
    common = F.array_intersect("held", "tokens")
    pairs = pairs.where((F.get(common, F.lit(0)) == F.col("word")) & (F.size(common) >= F.col("need")))  # a document and a template once

    # Places of the template's words, as (word number in the text, rank of the word in the template).
    hits = F.transform(F.filter("spots", lambda x: F.array_contains("tokens", x["w"])), lambda x: F.struct(x["i"].alias("i"), F.array_position("tokens", x["w"]).cast("int").alias("rank")))
    prefix = lambda x: x["rank"] <= F.col("m") - F.col("need") + 1

    def around(all_hits: Column) -> Column:
        """Per place of a prefix word, the hits that some block shares with it."""
        at = F.filter(F.transform(all_hits, lambda x, k: F.struct(k.alias("k"), x["i"].alias("i"), x["rank"].alias("rank"))), prefix)
        return F.transform(at, lambda a: F.struct(a["i"].alias("i"), a["rank"].alias("rank"), F.filter(F.slice(all_hits, F.greatest(F.lit(1), a["k"] + 2 - block), F.lit(2 * block - 1)), lambda y: F.abs(y["i"] - a["i"]) < block).alias("near")))

    ranks = lambda of, keep: F.size(F.array_distinct(F.transform(F.filter(of, keep), lambda y: y["rank"])))
    enough = F.filter(F.get(F.transform(F.array(hits), around), F.lit(0)), lambda a: ranks(a["near"], lambda y: y["rank"] >= a["rank"]) >= F.col("need"))  # the rarest common word of a block finds it
    found = pairs.select("doc_id", "h", "label", "m", "need", F.explode(enough).alias("a"))
    starts = F.filter("a.near", lambda x: x["i"] <= F.col("a.i"))
    blocks = F.transform(starts, lambda x: F.struct(ranks(F.col("a.near"), lambda y: (y["i"] >= x["i"]) & (y["i"] < x["i"] + block)).alias("n"), (-x["i"]).alias("before")))
    best = found.select("doc_id", "h", "label", "m", "need", F.array_max(blocks).alias("best")).where(F.col("best.n") >= F.col("need"))
    return best.select("doc_id", "h", (-F.col("best.before")).alias("start"), "label", (F.col("best.n") / F.col("m")).alias("containment"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, block: int = BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    d = docs.select("doc_id", text_or_empty().alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("spaced"))
    known = sentences(templates, threshold)
    vocabulary = sorted({w for _, words, _ in known for w in words})
    spaced = F.col("spaced")
    at = {p: places(spaced, p) for p in phrases}
    labels = F.array_compact(F.array(*[F.when(at[p][0] > 0, F.lit(label)) for p, label in phrases.items()]))
    low = lambda cols: F.array_min(F.array(*cols))
    base = d.select(
        "doc_id",
        "h",
        "spaced",
        (_blanks(spaced) - 1).cast("long").alias("n_words"),
        sum((x[0] for x in at.values()), F.lit(0)).cast("long").alias("n_base"),
        low([x[1] for x in at.values()]).cast("long").alias("first_word"),
        F.array_max(F.array(*[x[2] for x in at.values()])).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
        F.array_intersect(_words(vocabulary), F.split(spaced, " ")).alias("held"),
    )
    enough = F.lit(False)
    for _, words, need in known:
        enough = enough | (F.size(F.array_intersect("held", _words(words))) >= need)
    words = F.when((F.size("held") >= min(n for _, _, n in known)) & enough, F.split(F.trim("spaced"), " "))
    base = save(base.withColumn("words", words).drop("spaced"), "license-base")
    matches = template_matches(base.where("words is not null").select("doc_id", "h", "words"), base.select("held"), templates, block, threshold)
    best = matches.groupBy("doc_id", "h").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    out = base.join(best.withColumnsRenamed({"doc_id": "_id", "h": "_h"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", found)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
