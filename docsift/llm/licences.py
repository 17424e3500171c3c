"""Licence scans, with DataFrame functions alone.

A whole text and the templates are normalised alike (lower case, letters and digits, one space), so that it does not matter
how a notice is wrapped or what stands before and after it. Windows of a template's length begin at each word bigram of
the text that the template has; a window and a template are compared as sets of word bigrams by the Dice coefficient
2 |A and B| / (|A| + |B|). Since that is at most 2 min / (|A| + |B|), a template of b bigrams is only compared with windows of
b * t / (2 - t) to b * (2 - t) / t bigrams, needs so many hits in the text at least, and hence (words are chosen so that
too few bigrams are without them) one of a few words or pairs of words, which are looked for first. The templates are literals in the plan: nothing is shuffled but one
row for each document and licence found.

Defined results: null or empty texts have no windows; a text of one word has no bigram and matches nothing; of several
windows that match one licence the best tells, then the first; templates of equal score are all told; very long texts
are read whole; rows of one doc_id count as one document; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.7

# The notices by which these licences are declared, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def normalised(c: Column) -> Column:
    """Lower-case words of letters and digits between single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _least(n: int, threshold: float) -> int:
    """Bigrams of n that a window has at least, if its Dice coefficient reaches the threshold."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9)


def anchors(grams: set[tuple[str, str]], threshold: float) -> list[tuple[str, ...]]:
    """Words, long ones first, and pairs of short words, such that every window that reaches the threshold holds one of them."""
    left, out = set(grams), []
    single = sorted({(w,) for g in grams for w in g if len(w) > 4}, key=lambda x: (-len(x[0]), x))
    for found in [*single, *sorted(grams, key=lambda g: (-len(g[0] + g[1]), g))]:
        if len(left) < _least(len(grams), threshold):
            break
        now = {g for g in left if found[0] not in g} if len(found) == 1 else left - {found}
        if now != left:
            left = now
            out.append(found)
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, word (from 1, where its window begins), dice (6 decimals): the best window of each licence in each document."""
    sets = [(name, len(w) - 1, sorted(set(zip(w, w[1:], strict=False)))) for name, text in templates if len(w := _words(text)) > 1]
    grams_of = lambda s: F.array(*(F.lit(" ".join(p)) for p in s))
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("low"))
    # As parts of words too: what passes is looked at closely, and a search for bytes is many times faster than a pattern.
    some = F.lit(False)
    for found in sorted({x for _, _, s in sets for x in anchors(set(s), threshold)}):
        all_ = F.contains("low", F.lit(found[0]))
        some = some | (all_ & F.contains("low", F.lit(found[1])) if len(found) > 1 else all_)
    may = low.where(some)
    words = may.select("doc_id", F.split(normalised(F.col("low")), " ").alias("w")).where(F.size("w") > 1)
    grams = words.select("doc_id", F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)).alias("g"))
    vocabulary = grams_of(sorted({p for _, _, s in sets for p in s}))
    places = F.filter(F.transform("g", lambda x, i: F.when(F.array_contains(vocabulary, x), i + 1)), lambda i: i.isNotNull())
    fewest = min(_least(len(s), threshold) for _, _, s in sets)
    hits = grams.withColumn("at", places).where(F.size("at") >= fewest)

    def case(name: str, length: int, s: list[tuple[str, str]]) -> Column:
        mine, n = grams_of(s), len(s)

        def told(i: Column) -> Column:
            window = F.array_distinct(F.slice("g", i, length))
            inside = F.size(window).between(F.lit(n * threshold / (2 - threshold) - 1e-9), F.lit(n * (2 - threshold) / threshold + 1e-9))
            dice = F.round(2.0 * F.size(F.array_intersect(window, mine)) / (F.size(window) + n), 6)
            return F.when(inside, F.struct((-dice).alias("d"), i.alias("word")))

        starts = F.filter("at", lambda i: F.array_contains(mine, F.get(F.col("g"), i - 1)))
        best = F.transform(F.array(starts), lambda x: F.when(F.size(x) >= _least(n, threshold), F.array_min(F.transform(x, told))))[0]
        return F.struct(F.lit(name).alias("license"), best.alias("m"))

    cases = [case(*x) for x in sets]
    found = hits.select("doc_id", F.explode(F.array(*cases)).alias("c")).where(-F.col("c.m.d") >= threshold - 1e-12)
    first = found.groupBy("doc_id", F.col("c.license").alias("license")).agg(F.min("c.m").alias("m"))
    return first.select("doc_id", "license", F.col("m.word").cast("int").alias("word"), (-F.col("m.d")).alias("dice"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(' '.join(_words(text)))})" for i, (name, text) in enumerate(TEMPLATES))
    grams = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    return f"""
WITH templates(id, license, norm) AS (VALUES {values}),
t AS (SELECT id, license, {grams.format(w="string_split(norm, ' ')")} AS all_grams FROM templates),
s AS (SELECT id, license, len(all_grams) AS length, list_distinct(all_grams) AS b FROM t),
v AS (SELECT id, unnest(b) AS gram FROM s),
words AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT r, doc_id, {grams.format(w="w")} AS g FROM words WHERE len(w) > 1),
places AS (SELECT r, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS word FROM g),
starts AS (SELECT r, v.id, word FROM places JOIN v USING (gram) QUALIFY count(*) OVER (PARTITION BY r, v.id) >= ceil({low} * (SELECT len(b) FROM s WHERE s.id = v.id) - 1e-9)),
windows AS (SELECT g.doc_id, license, word, list_distinct(list_slice(g.g, word, word + length - 1)) AS a, b FROM starts JOIN g USING (r) JOIN s USING (id)),
best AS (SELECT doc_id, license, word, round(2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice FROM windows WHERE len(a) BETWEEN len(b) * {low} - 1e-9 AND len(b) * {high} + 1e-9)
SELECT doc_id, license, CAST(word AS INT) AS word, dice FROM best WHERE dice >= {THRESHOLD} - 1e-12
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, word) = 1"""


ORACLE = _oracle()
