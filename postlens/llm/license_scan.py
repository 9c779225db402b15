"""License scans: normalised text against licence templates by Dice over word bigrams.

Units of a text are its lines, its paragraphs (lines between blank ones) and the whole
text.  Normalised (lower case, runs of other characters than a-z and 0-9 as one space),
a unit matches a template if the Dice coefficient of their sets of word bigrams reaches
``PERCENT``.  Sizes bound the coefficient: a unit of a bigrams can only match templates
of b bigrams with ``a * t <= b <= a / t``, ``t = PERCENT / (200 - PERCENT)``; other
pairs are pruned before any is counted.

A unit that matches shares at least ``t * b`` of a template's b bigrams.  So it holds
one of a few words that occur in more than ``(1 - t) * b`` of them, and only texts with
such a word are cut into units: the first step is one regular expression over the text.
All steps are DataFrame functions; the templates are the only broadcast side.

Defined results: null and empty texts match nothing; equal units of one id count once,
so repeated rows change nothing; a null id is an id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERCENT = 80

# Customary notices of public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Words too common to tell a licence by.
COMMON = frozenset("a that all an and any are as at by for from in is it of on or the this to use was with you without not may if under".split())


def bigrams_of(text: str) -> set[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def telling_words(templates: list[tuple[str, str]], percent: int) -> list[str]:
    """Words so that every unit that matches any template holds one of them."""
    sets = [b for b in (bigrams_of(t) for _, t in templates) if b]
    seen = Counter(w for b in sets for w in {w for x in b for w in x.split()})
    chosen: set[str] = set()
    for b in sets:
        spare = len(b) - -(-percent * len(b) // (200 - percent))  # bigrams that a match may lack
        while sum(any(w in chosen for w in x.split()) for x in b) <= spare:
            left = Counter(w for x in b if not any(w in chosen for w in x.split()) for w in set(x.split()))
            chosen.add(max(left, key=lambda w: (w not in COMMON, w.isalpha(), left[w], seen[w], w)))
    return sorted(chosen)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """Distinct bigrams of an array of words; none of fewer than two."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


def matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, unit (normalised), license and dice of every unit that matches, for the
    licence of highest coefficient (all of them in a tie)."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = [(k, name, bigrams_of(t)) for k, (name, t) in enumerate(templates)]
    known = [x for x in known if x[2]]
    table = spark.createDataFrame([(k, name, len(b), x) for k, name, b in known for x in sorted(b)],
                                  "template int, license string, b int, bigram string")
    words = telling_words(templates, percent)
    if not words:
        return docs.select("doc_id", F.lit("").alias("unit"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).limit(0)
    low = min(len(x[2]) for x in known) * percent / (200 - percent)
    high = max(len(x[2]) for x in known) * (200 - percent) / percent
    text = F.col("text").cast("string")
    telling = docs.where(F.lower(text).rlike(r"(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z0-9])")).select("doc_id", text.alias("text"))
    units = telling.select("doc_id", F.explode(F.array_distinct(F.concat(
        F.split("text", "\n"), F.split("text", "\n[ \t\r]*\n"), F.array("text")))).alias("unit"))
    sized = (units.select("doc_id", normalised(F.col("unit")).alias("unit")).where(F.length("unit") > 0).distinct()
             .withColumn("words", F.split("unit", " ")).where(F.size("words") > 1)
             .withColumn("bigrams", bigrams(F.col("words"))).withColumn("a", F.size("bigrams"))
             .where(F.col("a").between(low, high)))
    pairs = (sized.select("doc_id", "unit", "a", F.explode("bigrams").alias("bigram"))
             .join(F.broadcast(table), "bigram")  # a few hundred rows
             .where((F.col("a") * percent <= F.col("b") * (200 - percent)) & (F.col("b") * percent <= F.col("a") * (200 - percent))))
    shared = pairs.groupBy("doc_id", "unit", "template", "license", "a", "b").agg(F.count("*").alias("c"))
    scored = (shared.where(200 * F.col("c") >= percent * (F.col("a") + F.col("b")))
              .groupBy("doc_id", "unit", "license").agg(F.max(2.0 * F.col("c") / (F.col("a") + F.col("b"))).alias("dice")))
    best = F.max("dice").over(Window.partitionBy("doc_id", "unit"))  # a few licences
    return scored.withColumn("best", best).where("dice = best").drop("best")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """doc_id, license, n_units (matching units, lines or more) and dice (of the best)."""
    return matches(docs, templates, percent).groupBy("doc_id", "license").agg(F.count("*").alias("n_units"), F.max("dice").alias("dice"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH given(template, license, body) AS (VALUES {", ".join(f"({k}, {_quoted(n)}, {_quoted(t)})" for k, (n, t) in enumerate(TEMPLATES))}),
given_words AS (SELECT template, license, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM given),
given_bigrams AS (SELECT DISTINCT template, license, w[i] || ' ' || w[i + 1] AS bigram
  FROM given_words, unnest(range(1, len(w))) AS r(i)),
sizes AS (SELECT template, count(*) AS b FROM given_bigrams GROUP BY template),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
norm AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')) AS unit FROM units),
words AS (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM norm WHERE unit <> ''),
grams AS (SELECT DISTINCT doc_id, unit, w[i] || ' ' || w[i + 1] AS bigram FROM words, unnest(range(1, len(w))) AS r(i)),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, unit) AS a FROM grams),
shared AS (SELECT g.doc_id, g.unit, t.template, t.license, g.a, count(*) AS c
  FROM counted g JOIN given_bigrams t USING (bigram) GROUP BY ALL),
scored AS (SELECT s.doc_id, s.unit, s.license, c, a, b FROM shared s JOIN sizes z USING (template)
  WHERE 200 * c >= {PERCENT} * (a + b)),
every AS (SELECT doc_id, unit, license, max(2.0::DOUBLE * c / (a + b)) AS dice FROM scored GROUP BY ALL),
best AS (SELECT * FROM every QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, unit))
SELECT doc_id, license, count(*) AS n_units, max(dice) AS dice FROM best GROUP BY doc_id, license
"""
