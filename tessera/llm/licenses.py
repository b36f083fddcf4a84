"""Licence scan: Dice similarity of word bigrams against licence templates.

A document is looked at as a whole and line by line, as the registered SQL does, so a
text or a line that is one of the templates is found. What is not: a notice wrapped over
several lines of a longer text, a notice within a line of other words, and a whole
licence file, as the templates are sentences and first paragraphs. A unit of text is normalised (ASCII
letters lowered, every run of other characters than letters and digits one
blank) and becomes the set of its word bigrams. A template of b bigrams can
reach the threshold t only with units whose set has between t/(2-t)*b and
(2-t)/t*b bigrams, so a unit is compared with the templates its size allows and
no others. Everything is DataFrame
functions over arrays in one pass per row: no shuffle, and nothing but the
template constants (a fixed list) is held beside the row.

Defined cases: null and empty texts have no units and match nothing; a unit
under two words has no bigram; ties go to the earliest unit (the whole text
counts as line 0, lines from 1) and then to the first template of the list;
repeated rows are answered one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

# Licence notices as they are published, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                 "the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                "rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]

THRESHOLD = 0.9


def _bigrams_of(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Smallest and largest bigram set that can reach ``threshold`` with one of
    ``n``: the overlap is at most the smaller set."""
    eps = 1e-9
    return math.ceil(threshold / (2 - threshold) * n - eps), math.floor((2 - threshold) / threshold * n + eps)


def _words(unit: Column) -> Column:
    lowered = F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.regexp_replace(lowered, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None,
                 threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, line, template, n_matches`` per document. The first four
    columns describe the best match (null without one; ``line`` 0 is the whole text),
    ``n_matches`` counts the units with a match."""
    grams = [(name, _bigrams_of(text)) for name, text in (TEMPLATES if templates is None else templates)]
    bounds = [size_bounds(len(g), threshold) for _, g in grams]
    least, most = min((lo for lo, _ in bounds), default=0), max((hi for _, hi in bounds), default=0)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.split("text", "\n")
    units = F.concat(F.array(F.struct(F.lit(0).alias("line"), F.col("text").alias("unit"))),
                     F.when(F.size(lines) > 1, F.transform(lines, lambda x, i: F.struct(
                         (i + 1).cast("int").alias("line"), x.alias("unit")))).otherwise(
                             F.array().cast("array<struct<line:int,unit:string>>")))
    with_units = rows.withColumn("units", units)

    def scored(u):
        return F.struct(u["line"].alias("line"), _words(u["unit"]).alias("words"))

    # n words give at most n - 1 bigrams: units too short for every template go first.
    long_enough = F.filter(F.transform("units", scored), lambda u: F.size(u["words"]) > max(least, 1))
    with_words = with_units.withColumn("units", long_enough)

    def bigrams(u):
        w = u["words"]
        return F.struct(u["line"].alias("line"), F.array_distinct(F.transform(
            F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))).alias("grams"))

    with_grams = with_words.withColumn("units", F.filter(
        F.transform("units", bigrams), lambda u: F.size(u["grams"]) <= most))

    def best(u):
        size = F.size(u["grams"])
        tries = []
        for k, ((name, g), (lo, hi)) in enumerate(zip(grams, bounds)):
            shared = F.size(F.array_intersect(u["grams"], F.array(*[F.lit(x) for x in g])))
            dice = 2.0 * shared / (size + F.lit(len(g)))
            tries.append(F.when(size.between(lo, hi), F.struct(
                dice.alias("dice"), (-u["line"]).alias("neg_line"), F.lit(-k).alias("neg_template"))))
        return F.greatest(*tries) if len(tries) > 1 else tries[0]

    if not grams:
        hits = F.array().cast("array<struct<dice:double,neg_line:int,neg_template:int>>")
    else:
        hits = F.filter(F.transform("units", best), lambda m: m["dice"] >= threshold)
    found = with_grams.withColumn("hits", hits).withColumn("top", F.array_max("hits"))
    names = F.array(*[F.lit(n) for n, _ in grams]) if grams else F.array().cast("array<string>")
    return found.select(
        "doc_id", F.get(names, -F.col("top.neg_template")).alias("license"), F.col("top.dice").alias("dice"),
        (-F.col("top.neg_line")).alias("line"), (-F.col("top.neg_template")).alias("template"),
        F.size("hits").cast("long").alias("n_matches"))


def license_oracle(templates=None, threshold: float = THRESHOLD) -> str:
    """The same by DuckDB, every unit against every template, without pruning."""
    rows = []
    for k, (name, text) in enumerate(TEMPLATES if templates is None else templates):
        listed = ", ".join("'" + g + "'" for g in _bigrams_of(text))
        rows.append(f"({k}, '{name}', [{listed}])")
    return f"""
WITH templates(template, license, grams) AS (VALUES {', '.join(rows)}),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT doc_id, 0 AS line, text AS unit FROM lines
  UNION ALL
  SELECT doc_id, i AS line, ls[i] AS unit FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines WHERE len(ls) > 1)),
words AS (
  SELECT doc_id, line, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z0-9]+') AS w FROM units),
sets AS (
  SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM words WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, line, template, license,
         2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM sets, templates WHERE len(list_intersect(g, grams)) > 0),
hits AS (SELECT * FROM scored WHERE dice >= {threshold}),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, template) AS r FROM hits),
counts AS (SELECT doc_id, count(DISTINCT line) AS n_matches FROM hits GROUP BY doc_id)
SELECT d.doc_id, t.license, t.dice, t.line::INT AS line, t.template::INT AS template,
       coalesce(c.n_matches, 0)::BIGINT AS n_matches
FROM documents d LEFT JOIN (SELECT * FROM top WHERE r = 1) t ON d.doc_id = t.doc_id
LEFT JOIN counts c ON d.doc_id = c.doc_id"""
