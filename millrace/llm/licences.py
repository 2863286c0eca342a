"""Licence scan: normalised text units against licence templates by the Dice coefficient of their word bigrams.

A unit is a line, a paragraph of several lines (between blank lines) or the whole text. Units are lower-cased, runs of other
characters than a-z and 0-9 become one space, and their distinct word bigrams are compared with each template's. A Dice
coefficient of at least THRESHOLD needs sizes within a factor of THRESHOLD / (2 - THRESHOLD) of each other, so a template
is a candidate only for units within its bounds. It also needs more than that share of the template's bigrams; therefore a
unit without any of the rarer words that every such share contains can't match, and one regular expression passes over the
others before any bigram is made. Both are consequences of the threshold: nothing is lost. DataFrame functions only.

Defined results: null, empty and wordless texts match nothing (n_matches 0, licences '', best_dice 0); a licence counts
once for each unit that matches, and a text that is itself one line is one unit; repeated rows are scanned alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Added to size bounds, so that rounding excludes no unit that just reaches the threshold.
SLACK = 1e-6

#: Notices and permission paragraphs of common licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
]
#: Words too common to pick units by.
COMMON = frozenset(
    "a above all and any appear are as at be by can for form forms free from if in including is it may met not of on one "
    "or out permitted person persons provided purpose source that the this to under use used was whom with without work "
    "you your 0 2 3 4 http www file files copy copies following conditions either later rights source terms version".split()
)


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigram_set(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def sign_words(grams: list[str], threshold: float = THRESHOLD) -> set[str]:
    """Words of which a unit must have one to reach the threshold with a template of these bigrams."""
    most_missing = int(len(grams) * (1 - threshold / (2 - threshold)) + 1e-9)
    rare = sorted(grams, key=lambda g: min((w in COMMON, -len(w)) for w in g.split()))[: most_missing + 1]
    return {min(g.split(), key=lambda w: (w in COMMON, -len(w))) for g in rare}


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(unit: Column) -> Column:
    words = F.split(unit, " ")
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda g: g.isNotNull()))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_matches, licences (names, sorted, joined by commas) and best_dice."""
    sets = [(name, bigram_set(normal_words(text))) for name, text in templates]
    part = threshold / (2 - threshold)
    least = min(len(g) for _, g in sets) * part - SLACK
    signs = sorted(set().union(*[sign_words(g, threshold) for _, g in sets]))
    sign = r"(?:^|[^a-z0-9])(?:" + "|".join(signs) + r")(?:[^a-z0-9]|$)"

    text = docs["text"].cast("string")
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = F.array_union(F.array_union(lines, paragraphs), F.array(text))
    signed = F.filter(units, lambda u: F.lower(u).rlike(sign))
    normal = F.array_distinct(F.transform(signed, normalised))

    # Bounds on the number of bigrams before any is made: a unit has at most one less than it has words.
    large_enough = F.filter(normal, lambda u: F.size(F.split(u, " ")) - 1 >= least)

    def matches(unit: Column) -> Column:
        own = bigrams(unit)
        found = []
        for name, grams in sets:
            fits = (F.size(own) >= len(grams) * part - SLACK) & (F.size(own) <= len(grams) / part + SLACK)
            common = F.size(F.array_intersect(own, F.array(*[F.lit(g) for g in grams])))
            dice = F.when(fits, 2.0 * common / (F.size(own) + len(grams))).otherwise(0.0)
            found.append(F.struct(F.lit(name).alias("name"), dice.alias("dice")))
        return F.filter(F.array(*found), lambda m: m["dice"] >= threshold)

    every = docs.select("doc_id", F.coalesce(F.flatten(F.transform(large_enough, matches)), F.expr("cast(array() as array<struct<name:string,dice:double>>)")).alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"])))
    return every.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licences"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"),
    )


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB's SQL, every unit against every template."""
    rows = ",\n".join(
        f"({i}, '{name}', [{', '.join(repr(g) for g in bigram_set(normal_words(text)))}])"
        for i, (name, text) in enumerate(templates)
    )
    return rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
templates(id, name, grams) AS (VALUES {rows}),
units AS (
    SELECT r, unnest(list_distinct(list_transform(
        string_split(text, chr(10))
        || list_filter(string_split_regex(text, '\n[ \t\r]*\n'), lambda p: contains(p, chr(10)))
        || [text],
        lambda u: trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g'))))) AS unit
    FROM docs WHERE text IS NOT NULL
), worded AS (SELECT DISTINCT r, unit, string_split(unit, ' ') AS w FROM units),
grams AS (
    SELECT r, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM worded
), scored AS (
    SELECT r, t.id, name, 2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice
    FROM grams, templates t
), matched AS (SELECT * FROM scored WHERE dice >= {threshold})
SELECT d.doc_id, count(m.id) AS n_matches,
    coalesce(string_agg(DISTINCT m.name, ',' ORDER BY m.name), '') AS licences,
    coalesce(max(m.dice), 0.0)::DOUBLE AS best_dice
FROM docs d LEFT JOIN matched m ON m.r = d.r GROUP BY d.r, d.doc_id
"""
