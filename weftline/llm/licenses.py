"""License scans with DataFrame functions only.

Units of a document are its whole text (``line_no`` 0) and each of its lines
(from 1). A unit's words are the runs of a-z and 0-9 after lower-casing A-Z; its
set of distinct word bigrams is compared with every template's by the Dice
coefficient ``2 c / (a + b)``. A coefficient of ``t`` or more is possible only
for set sizes with ``t / (2 - t) <= a / b <= (2 - t) / t``; these bounds leave a
few candidate templates; a unit without a key word of any template (see
:func:`key_words`) is passed over at once.
Everything is a narrow projection: no shuffle, no join, so no hot key.

Defined results: null and empty texts, and units of fewer than two words, match
nothing; of templates tied for the best coefficient the alphabetically first is
named; repeated rows give repeated rows; empty tables give empty tables; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8

# Notices of public licences, in their usual words.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c in LOWER + "0123456789" else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bigrams(text: Column) -> Column:
    """Distinct word bigrams; an empty array below two words."""
    words = F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def key_words(grams: list[str], threshold: float) -> set[str]:
    """Words of which every match has at least one.

    A match holds at least ``t / (2 - t)`` of the template's bigrams, so of any
    set of one bigram more than may be missing it holds one, and its words.
    """
    needed = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
    longest = sorted((max(g.split(), key=len) for g in grams), key=lambda w: (-len(w), w))
    return set(longest[: len(grams) - needed + 1])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, line_no, license, dice`` of every unit with its best template."""
    known = {name: template_bigrams(t) for name, t in sorted(templates.items())}
    known = {name: b for name, b in known.items() if b}
    grams = F.array(*(F.lit(g) for g in sorted({g for b in known.values() for g in b}))).cast("array<string>")
    table_ = F.array(*(F.struct(F.lit(n).alias("license"), F.array(*(F.lit(g) for g in b)).alias("grams")) for n, b in known.items()))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    words = sorted(set().union(*(key_words(g, threshold) for g in known.values())))
    some_word = lambda c: reduce(Column.__or__, (c.contains(w) for w in words), F.lit(False))
    # lower() may also map other letters to a-z: this filter keeps more, never less
    near = docs.select(key, text, F.explode(F.array(F.lower(text))).alias("low")).where(some_word(F.col("low")))
    units = near.select(F.col(key), F.posexplode(F.concat(F.array(text), F.split(text, "\n"))).alias("line_no", "unit")).where(some_word(F.lower("unit")))
    # explode(array(x)) keeps x as a column of its own: projected expressions would be merged and computed again at each use
    sets = units.select(key, F.col("line_no").cast("bigint"), F.explode(F.array(bigrams(F.col("unit")))).alias("b"))
    some = sets.where(F.arrays_overlap("b", grams)).select(key, "line_no", "b", F.explode(F.array(F.size("b"))).alias("n"))
    fits = F.filter(table_, lambda t: (F.col("n") >= F.size(t["grams"]) * low) & (F.col("n") <= F.size(t["grams"]) * high))
    scored = F.transform(
        fits,
        lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(F.col("b"), t["grams"])) / (F.col("n") + F.size(t["grams"]))).alias("dice"), t["license"].alias("license")),
    )
    hits = some.select(key, "line_no", F.explode(F.array(F.filter(scored, lambda s: s["dice"] >= threshold))).alias("good")).where(F.size("good") > 0)
    best = F.reduce("good", F.element_at("good", 1), lambda x, s: F.when(s["dice"] > x["dice"], s).otherwise(x))
    return hits.select(key, "line_no", best.alias("best")).select(key, "line_no", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{g}'" for g in template_bigrams(t))) for n, t in sorted(TEMPLATES.items()))
    clean = f"trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH t(license, g) AS (VALUES {rows}),
u AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS line_no, text AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, CAST(i AS BIGINT), string_split(text, chr(10))[i] FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS x(i) WHERE text IS NOT NULL
),
w AS (SELECT doc_id, line_no, string_split({clean}, ' ') AS w FROM u),
b AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) >= 2),
d AS (SELECT doc_id, line_no, license, 2.0::DOUBLE * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice FROM b, t WHERE list_has_any(b, g)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, license) AS k FROM d WHERE dice >= {THRESHOLD})
SELECT doc_id, line_no, license, dice FROM r WHERE k = 1"""


OP5_SQL = _sql()
