"""License scan: exact set-similarity join of text blocks with license texts.

DataFrame functions only.  Words are lower-cased (A-Z) runs of everything that
is no ASCII mark, space or control character.  Two findings are made:

* *base* places: where the words of a phrase stand consecutively;
* template matches: a block of text (a run of up to ``BLOCK`` words of the
  text, whatever its line breaks; runs overlap by half) holds at least
  ``percent`` hundredths of the distinct words of a template (containment), and
  all of its telling words, those that set it apart from related licenses.
  Of related templates (a family) in one block those with the most telling
  words count, so that a notice of the Lesser GPL is none of the GPL.

The template join is exact.  The template words are ordered by their frequency
in all documents, rarest first.  A block that reaches the threshold holds one
of the first ``|T| - needed + 1`` words of the template (prefix filter), has at
least ``needed`` template words (length filter), and at the first common word
enough words must remain on both sides (positional filter).  What passes is
verified by intersecting the sets.  The templates are constants of this
module, so that their words and prefixes are small literals; counts of the
template words, at most one row each, are all that comes to the driver.

Cases: null or empty texts have no words and no labels (empty strings), null
first and last word and score 0; repeated rows each get their own result; a
null doc_id is kept; an empty table gives an empty result; other columns are
ignored.  Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 200

#: Phrases and the labels of their places.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Labels, families, telling words and texts of public license notices.
TEMPLATES = [
    ("mit", "mit", "permission hereby", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit", "mit", "Released under the MIT License"),
    ("apache", "apache", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "apache", "apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("gpl", "gnu", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "gnu", "gnu", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "gnu", "gnu lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "gnu", "gnu affero", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "bsd", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "isc", "permission hereby purpose", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unlicense", "unencumbered", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "cc", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "cc", "creative commons attribution sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "cc", "creative commons attribution noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "cc-short", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "cc0", "cc0 waived", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related rights"),
    ("proprietary", "proprietary", "rights reserved permission", "All rights reserved. No part of this work may be reproduced without prior written permission of the copyright holder"),
]

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    number: int
    label: str
    family: str
    telling: list[str]
    words: list[str]  # distinct


def template_words() -> list[Template]:
    return [Template(i, label, family, sorted(telling.split()), sorted(set(re.findall(r"[a-z0-9]+", text.lower())))) for i, (label, family, telling, text) in enumerate(TEMPLATES)]


def words_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(folded, _SEPARATORS), lambda w: w != "")


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase; the cheap test for its first word comes first."""
    parts = phrase.split()
    here = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0))),
        lambda i: F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase,
    )
    return F.when((F.size(words) >= len(parts)) & F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0]), here).otherwise(F.array().cast("array<int>"))


def base_places(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """``key, doc_id, n_words, places, base`` (labels found) of every row."""
    found = docs.select("key", "doc_id", words_of(F.col("text")).alias("words"))
    every = found.select("key", "doc_id", F.size("words").cast("long").alias("n_words"), *[_places(F.col("words"), p).alias(f"at{i}") for i, (p, _) in enumerate(phrases)])
    places = F.concat(*[F.col(f"at{i}") for i in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    return every.select("key", "doc_id", "n_words", places.alias("places"), F.array_distinct(labels).alias("base"))


def word_order(docs: DataFrame) -> dict[str, int]:
    """Place of each template word in the order of document frequency."""
    known = sorted({w for t in template_words() for w in t.words})
    held = F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, known)))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()  # a row a template word at most
    often = {r.word: r.n for r in counts}
    return {w: i for i, w in enumerate(sorted(known, key=lambda w: (often.get(w, 0), w)))}


def template_matches(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``key, label, containment`` of every block and template that reach the
    threshold (the best of a text and label)."""
    spark = docs.sparkSession
    order = word_order(docs)
    rows, first = [], set()
    for t in template_words():
        ws = sorted(t.words, key=order.get)
        needed = math.ceil(percent * len(ws) / 100)
        for pos, w in enumerate(ws[:len(ws) - needed + 1]):
            rows.append((t.number, t.label, t.family, t.telling, ws, needed, w, pos))
            first.add(w)
    templates = spark.createDataFrame(rows, "template int, label string, family string, telling array<string>, words array<string>, needed int, word string, pos int")
    known = F.array(*[F.lit(w) for w in sorted(order, key=order.get)])
    prefix = F.array(*[F.lit(w) for w in sorted(first)])

    # blocks of the texts that hold some prefix word at all
    texts = docs.select("key", words_of(F.col("text")).alias("words")).where(F.arrays_overlap("words", prefix))
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - BLOCK // 2 - 1, F.lit(0)), F.lit(BLOCK // 2))
    runs = texts.select("key", "words", F.explode(begins).alias("begin")).select("key", "begin", F.slice("words", F.col("begin") + 1, BLOCK).alias("run"))
    # the template words of a block, rarest first
    blocks = runs.select("key", "begin", F.array_intersect(known, "run").alias("held"))
    tokens = blocks.select("key", "begin", "held", F.size("held").alias("n"), F.posexplode("held").alias("at", "word"))
    near = tokens.join(F.broadcast(templates), "word").where("n >= needed and 1 + least(size(words) - pos - 1, n - at - 1) >= needed")
    shared = F.size(F.array_intersect("words", "held"))
    told = F.size(F.array_except("telling", "held")) == 0
    found = near.where(told).select("key", "begin", "family", F.size("telling").alias("special"), "label", shared.alias("shared"), F.size("words").alias("size"), "needed").where("shared >= needed")
    # of a family in a block (a handful of templates) the most special ones
    families = found.groupBy("key", "begin", "family").agg(F.max("special").alias("most"), F.collect_set(F.struct("special", "label", (F.col("shared") / F.col("size")).alias("containment"))).alias("of"))
    best = families.select("key", F.explode(F.filter("of", lambda m: m["special"] == F.col("most"))).alias("m"))
    return best.groupBy("key", F.col("m.label").alias("label")).agg(F.max("m.containment").alias("containment"))


def scan(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_words, places, base, matches`` of every row: places of the
    phrases (word numbers from 0), their labels, and the labels of the
    templates with their containment."""
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    matches = template_matches(keyed, percent).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("label", "containment"))).alias("matches"))
    return base_places(keyed).join(matches, "key", "left").select("doc_id", "n_words", "places", "base", F.coalesce("matches", F.array().cast(matches.schema["matches"].dataType)).alias("matches"))
