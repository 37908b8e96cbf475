"""License scan: passages of texts that hold most of the words of a known license text.

An exact set-similarity join of blocks of text with license templates. A block is
a window of twice as many words as templates of its size class may have, and a
window starts every half window, so each run of that many words lies in one block. A
template is found where a block holds the given share of its different words.

The template words are put in one order, rarest in the corpus first. If a block and
a template share enough words, the first few of each in that order share one
(prefix filter): only blocks with such a word are made, and they meet templates by
it. Pairs that cannot reach the share by the number of words left go (length and
position filters); the others are compared whole. All DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import LOWER, UPPER, stored

# Labels and the phrases that name a license.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

# Labels and wording of licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    ("bsd", "Released under the BSD License"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
    ),
    ("gpl", "Licensed under the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
    ),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    ("epl-2.0", "Eclipse Public License version 2.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will "
        "the authors be held liable for any damages arising from the use of this software",
    ),
    ("boost", "Boost Software License Version 1.0"),
)

# Share of a template's different words that a block must hold, in percent.
SHARE = 90
# Words of all templates together; beyond it they are no broadcast.
MOST_WORDS = 100_000
LEAST_CLASS = 8
# A text that many rows hold is joined in so many parts.
PARTS = 16

_OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words_of(text: Column) -> Column:
    """The words of a text: runs of a-z, 0-9 and of what is not ASCII, A-Z lower-cased."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _OTHER + UPPER, " " * len(_OTHER) + LOWER)
    return F.array_remove(F.split(spaced, " "), "")


def template_words(text: str) -> list[str]:
    return WORD.findall(text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class Template:
    """Words of a template in the common order, and how many of them a block must hold."""

    number: int
    label: str
    words: tuple[str, ...]
    size_class: int
    needed: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.needed + 1]


def _size_class(words: int) -> int:
    return max(LEAST_CLASS, 1 << math.ceil(math.log2(words)))


def prepared(
    templates: Sequence[tuple[str, str]], counts: Mapping[str, int], share: int
) -> list[Template]:
    """The templates with their words from the rarest to the most frequent."""
    made = []
    for number, (label, text) in enumerate(templates):
        words = template_words(text)
        if not words:
            raise ValueError(f"no words in the template of {label}")
        order = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        needed = -(-share * len(order) // 100)
        made.append(Template(number, label, tuple(order), _size_class(len(words)), needed))
    if sum(len(t.words) for t in made) > MOST_WORDS:
        raise ValueError("the templates have too many words")
    return made


def _word_counts(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many texts each template word occurs; at most ``MOST_WORDS`` rows."""
    listed = F.array(*[F.lit(w) for w in vocabulary])
    held = words.select(F.explode(F.array_intersect("_words", listed)).alias("word"))
    return {row["word"]: row["n"] for row in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _blocks(words: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """Blocks with a prefix word: text, size class, block, and its template words as ranks."""
    spark = words.sparkSession
    order = {}
    for t in templates:
        order.setdefault(t.size_class, {}).update(dict.fromkeys(t.words))
    rows = []
    for size, held in order.items():
        firsts = {w for t in templates if t.size_class == size for w in t.prefix}
        rows += [(w, size, w in firsts) for w in held]
    known = spark.createDataFrame(rows, "word string, size int, first boolean")
    firsts = sorted({w for w, _, first in rows if first})
    # Only texts with some prefix word can hold a block.
    texts = words.where(F.arrays_overlap("_words", F.array(*[F.lit(w) for w in firsts])))
    placed = texts.select("_h1", "_h2", F.posexplode("_words").alias("at", "word"))
    cell = F.expr("at div size")
    return (
        placed.join(F.broadcast(known), "word")
        .withColumn("block", F.explode(F.array(cell, cell - 1)))
        .where(F.col("block") >= 0)
        .groupBy("_h1", "_h2", "size", "block")
        .agg(F.collect_set("word").alias("held"), F.bool_or("first").alias("first"))
        .where("first")
        .drop("first", "block")
        .distinct()
    )


def _matches(words: DataFrame, templates: Sequence[Template], counts: Mapping[str, int]) -> DataFrame:
    """Per text its templates' labels and the largest share of one's words in a block."""
    spark = words.sparkSession
    index = spark.createDataFrame(
        [
            (t.size_class, word, place, t.label, list(t.words), t.needed)
            for t in templates
            for place, word in enumerate(t.prefix)
        ],
        "size int, word string, _i int, label string, _template array<string>, _needed int",
    )
    ranked = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    least = {}
    for t in templates:
        least[t.size_class] = min(t.needed, least.get(t.size_class, t.needed))
    fewest = F.coalesce(*[F.when(F.col("size") == s, F.lit(n)) for s, n in least.items()])
    # The words of a block in the common order.
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in ranked]), F.col("held"))
    blocks = (
        _blocks(words, templates)
        .withColumn("held", ordered)
        .withColumn("_prefix", F.size("held") - fewest + 1)
        .where(F.col("_prefix") > 0)
        .select("_h1", "_h2", "size", "held", F.posexplode(F.expr("slice(held, 1, _prefix)")).alias("_j", "word"))
    )
    left = F.least(F.size("_template") - F.col("_i"), F.size("held") - F.col("_j"))
    shared = F.size(F.array_intersect("held", "_template"))
    return (
        blocks.join(F.broadcast(index), ["size", "word"])
        .where((F.size("held") >= F.col("_needed")) & (left >= F.col("_needed")))
        .withColumn("_shared", shared)
        .where(F.col("_shared") >= F.col("_needed"))
        .groupBy("_h1", "_h2")
        .agg(
            F.collect_set("label").alias("_found"),
            F.max(F.col("_shared") / F.size("_template")).alias("_share"),
        )
    )


def _phrase_places(words: str, phrase: Sequence[str]) -> Column:
    """Places where the words of a phrase stand one after another; a text without them costs a glance."""
    last = F.size(words) - len(phrase)
    places = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: _stands(words, phrase, i),
    )
    rarely = F.array_contains(words, phrase[-1]) & F.array_contains(words, phrase[0]) & (last >= 0)
    return F.when(rarely, places).otherwise(F.array().cast("array<int>"))


def _stands(words: str, phrase: Sequence[str], at: Column) -> Column:
    held = F.lit(True)
    for k, word in enumerate(phrase):
        held &= F.get(words, at + k) == word
    return held


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    share: int = SHARE,
) -> DataFrame:
    """Every row with the licenses its text names or holds.

    ``n_words``; ``n_base``, the places of all phrases; ``first_word`` and ``last_word``,
    the smallest and largest word they start at (null if none); ``base_labels``, of the
    phrases, and ``labels``, of the templates too, each distinct, sorted, joined by
    commas; ``score``, 1 for a phrase, else the largest share of a template's words
    that a block holds, 0 below ``share`` percent. These replace input columns of the
    same name in any case; all others stay as they are.

    A null text is empty; an empty text has no words and no labels. Repeated rows
    and equal texts get equal results. A very long text is handled word by word, never
    cut. No rows give no rows.
    """
    columns = [c for c in docs.columns if c.lower() not in RESULTS]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashes = (F.xxhash64(body), F.xxhash64(F.lit("license"), body))
    worded = docs.select(words_of(F.col(f"`{text}`")).alias("_words"), hashes[0].alias("_h1"), hashes[1].alias("_h2"))
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError("the templates have too many words")
    counts = _word_counts(worded, vocabulary) if vocabulary else {}
    prepared_templates = prepared(templates, counts, share)
    kinds = "_h1 long, _h2 long, _found array<string>, _share double"
    found = (
        stored(_matches(worded, prepared_templates, counts), "license-matches")
        if prepared_templates
        else docs.sparkSession.createDataFrame([], kinds)
    )
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    found = found.withColumn("_part", parts)
    # The row travels as one struct, so no name of its own can clash.
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
        words_of(F.col(f"`{text}`")).alias("_words"),
        hashes[0].alias("_h1"),
        hashes[1].alias("_h2"),
        F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int").alias("_part"),
    )
    places = [
        (label, _phrase_places("_words", template_words(phrase))) for label, phrase in phrases
    ]
    rows = rows.select(
        "_row", "_h1", "_h2", "_part",
        F.size("_words").cast("long").alias("n_words"),
        *[at.alias(f"_p{k}") for k, (_, at) in enumerate(places)],
    )
    every = F.concat(*[F.col(f"_p{k}") for k in range(len(places))])
    named = F.array_compact(
        F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(places)])
    )
    based = rows.select(
        "_row", "_h1", "_h2", "_part", "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(named)).alias("_named"),
    )
    more = F.coalesce("_found", F.array().cast("array<string>"))
    return based.join(found, ["_h1", "_h2", "_part"], "left").select(
        *[F.col(f"_row.`{c}`").alias(c) for c in columns],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_named", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_named", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
