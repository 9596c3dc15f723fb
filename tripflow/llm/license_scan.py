"""Licence scans by Dice coefficient over word bigrams, with DataFrame functions only.

A text is lower-cased and other characters than a-z and 0-9 become spaces. Its units are its lines and itself. A unit's set of word
bigrams (or its single word) is held against each template's. Dice >= t needs set sizes within t / (2 - t) of each other, so a unit meets only the
templates whose admissible sizes hold its own.

With ``windows`` runs of words are held against the templates, too, so notices that wrap over lines, stand inside a longer text or have words
put in are found: all runs that begin and end with one of the template's bigrams (any other match is one of these with words around it that
only lower its Dice) and are no longer than the admissible size. Of the runs that begin at one word the best one counts, the shorter of equal
ones. A run doesn't count beside one that overlaps it and is better: of greater Dice, then longer, then of the first licence by name, then earlier.
A template of one word matches that word.

Dice >= t needs, too, that so many of a template's bigrams are there that one of its anchors is: the longest bigrams, as many as
can be missing and one more. One search for all anchors tells which texts can have a match at all; the others are not cut up.

Null or wordless texts have no units. A unit counts for its best licence, ties to the first by name; per document and licence the
best Dice and the number of such lines and texts are returned, and the same of windows. Rows that repeat a doc_id are scanned row by row and
reported as one document. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Mapping, Sequence
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import Tables

#: Licence notices, headers and texts in common use, by SPDX identifier.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This work is licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Licensed under the ISC License.", "Released under the ISC License."],
    "MIT": ["Licensed under the MIT License.", "Released under the MIT License.", "This work is licensed under the MIT License."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version {} of the License, or (at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""

#: The operative text of licences and their usual headers.
TEXTS: Mapping[str, Sequence[str]] = {
    "Apache-2.0": [_APACHE], "BSD-2-Clause": [_BSD2], "BSD-3-Clause": [_BSD2 + _BSD3], "GPL-2.0": [_GPL.format(2)], "GPL-3.0": [_GPL.format(3)],
    "ISC": [_ISC], "MIT": [_MIT], "MPL-2.0": [_MPL],
}


def words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(normal: Column) -> Column:
    """The set of word bigrams of a normalised text; of its single word if it has no more."""
    return _grams(F.split(normal, " "))


def _grams(w: Column) -> Column:
    n = F.size(w) - 1
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(n > 0, pairs).otherwise(w))


class Template(NamedTuple):
    license: str
    words: list[str]
    grams: list[str]
    anchors: list[str]
    needed: int  # bigrams of the template that a match has at least

    @classmethod
    def of(cls, license: str, text: str, threshold: Fraction) -> Template:
        w = re.findall("[a-z0-9]+", text.lower())
        grams = list(dict.fromkeys(" ".join(w[i : i + 2]) for i in range(max(len(w) - 1, 1))))
        needed = math.ceil(threshold / (2 - threshold) * len(grams))
        return cls(license, w, grams, sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - needed + 1], needed)


def known(templates: Sequence[Mapping[str, Sequence[str]]], threshold: float) -> list[Template]:
    """All templates that have words, by licence."""
    exact = Fraction(str(threshold))  # in doubles, 0.8 / 1.2 is above 2/3 and would cut sizes on the bounds
    found = [Template.of(k, t, exact) for each in templates for k, ts in each.items() for t in ts]
    return sorted((t for t in found if t.words), key=lambda t: t.license)


def anchor_pattern(templates: Sequence[Template]) -> str:
    """A pattern of lower-case text that has one of the templates' anchors."""
    by_letter: dict[str, list[str]] = {}
    for g in sorted({g for t in templates for g in t.anchors}):
        by_letter.setdefault(g[0], []).append(g[1:].replace(" ", "[^a-z0-9]+"))
    return "(?<![a-z0-9])(?:" + "|".join(f"{x}(?:{'|'.join(rest)})" for x, rest in by_letter.items()) + ")(?![a-z0-9])"


def _literal(rows: Sequence[Sequence], schema: str) -> Column:
    """A constant array of structs, folded once when the plan is made."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return F.from_json(F.lit(json.dumps([dict(zip(names, row, strict=True)) for row in rows])), f"array<struct<{schema.replace(' ', ': ')}>>".replace(",: ", ", "))


def _best(u: Column, templates: Column, fits: Callable[[Column], Column]) -> Column:
    """(-dice, license) of the best of the templates that fit."""
    def measured(x: Column) -> Column:
        return F.struct((-2.0 * F.size(F.array_intersect(u, x["t"])) / (F.size(u) + F.size(x["t"]))).alias("o"), x["license"].alias("license"))

    return F.array_min(F.transform(F.filter(templates, fits), measured))


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = 0.8, windows: bool = False, texts: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(doc_id, license, dice, n_units) for every licence that is the best match of some unit of a document.

    windows: also look for templates, and for texts if given, in runs of words, and return (window_dice, n_windows).
    """
    found = known([templates, *([texts] if texts else [])], threshold)
    low, high = (Fraction(str(threshold)) / (2 - Fraction(str(threshold)))).as_integer_ratio()
    sizes = [(t.license, t.grams, -(-len(t.grams) * low // high), len(t.grams) * high // low) for t in found]
    rows = _literal(sizes, "license string, t array<string>, lo int, hi int")
    lower = F.lower("text")
    body = F.regexp_replace(lower, "[^a-z0-9\n]+", " ")
    whole = F.trim(F.regexp_replace(body, "[ \n]+", " "))
    # Written, so that the search for anchors runs once: few texts have any.
    near = Tables(docs.sparkSession, "licences").save(docs.where(lower.rlike(anchor_pattern(found)) if found else F.lit(False)).select("doc_id", F.monotonically_increasing_id().alias("row"), body.alias("body"), whole.alias("whole")))
    units = F.when(F.contains("body", F.lit("\n")), F.concat(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), F.array("whole"))).otherwise(F.array("whole"))
    grams = near.select("doc_id", F.explode(units).alias("w")).where("w <> ''").select("doc_id", F.explode(F.array(bigrams(F.col("w")))).alias("u"))
    best = grams.select("doc_id", _best(F.col("u"), rows, lambda x: F.size("u").between(x["lo"], x["hi"])).alias("b")).where(F.col("b.o") <= -threshold)
    out = best.groupBy("doc_id", F.col("b.license").alias("license")).agg(F.max(-F.col("b.o")).alias("dice"), F.count("*").alias("n_units"))
    if not windows:
        return out
    inside = _best_runs(_runs(near, found, [hi for *_, hi in sizes], threshold), max([hi for *_, hi in sizes], default=0) + 1)
    more = inside.groupBy("doc_id", "license").agg(F.max("dice").alias("window_dice"), F.count("*").alias("n_windows"))
    both = out.withColumns({"window_dice": F.lit(None).cast("double"), "n_windows": F.lit(0).cast("long")}).unionByName(more.withColumns({"dice": F.lit(None).cast("double"), "n_units": F.lit(0).cast("long")}))
    return both.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.sum("n_units").alias("n_units"), F.max("window_dice").alias("window_dice"), F.sum("n_windows").alias("n_windows"))


def _runs(near: DataFrame, templates: Sequence[Template], longest: Sequence[int], threshold: float) -> DataFrame:
    """(row, doc_id, license, start, end, dice): of each template and each word where a run may begin, the best run if it matches."""
    spark = near.sparkSession
    rows = [(i, t.license, t.grams, len(t.grams), t.needed, most) for i, (t, most) in enumerate(zip(templates, longest, strict=True)) if len(t.words) > 1]
    known_ = spark.range(1).select(F.explode(_literal(rows, "id int, license string, t array<string>, n int, needed int, most int")).alias("k")).select("k.*")
    # A generated column is computed once a row; an expression would be, once a lambda call.
    split = near.select("row", "doc_id", F.explode(F.array(F.split("whole", " "))).alias("w"))
    n = F.size("w") - 1
    pairs = F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = split.where("size(w) > 1").select("row", "doc_id", F.posexplode(pairs).alias("p", "g"))
    # Where the same bigram stood before: in a run from s on, it is new if that is before s.
    grams = grams.withColumn("before", F.coalesce(F.lag("p").over(Window.partitionBy("row", "g").orderBy("p")), F.lit(-1)))
    hits = grams.join(F.broadcast(known_.select("id", "license", "n", "needed", "most", F.explode("t").alias("g"))), "g")  # the templates' bigrams are parameters
    keys = ["row", "doc_id", "id", "license", "n", "needed", "most"]
    enough = hits.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("hits"), F.count_if(F.col("before") < 0).alias("m")).where("m >= needed")
    whole = grams.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "before"))), lambda x: x["before"]).alias("before"))
    found = enough.join(whole, "row").withColumn("is_hit", F.transform(F.sequence(F.lit(0), F.size("before") - 1), lambda p: F.array_contains("hits", p)))

    def best(start: Column) -> Column:
        def step(x: Column, p: Column) -> Column:
            new = (F.get("before", p) < start).cast("int")
            u, h = x["u"] + new, x["h"] + F.when(F.get("is_hit", p), new).otherwise(0)
            dice = F.when(F.get("is_hit", p), 2.0 * h / (u + F.col("n"))).otherwise(0.0)
            ahead = dice > x["dice"]
            return F.struct(u.alias("u"), h.alias("h"), F.when(ahead, dice).otherwise(x["dice"]).alias("dice"), F.when(ahead, p + 2).otherwise(x["end"]).alias("end"))

        zero = F.struct(F.lit(0).alias("u"), F.lit(0).alias("h"), F.lit(0.0).alias("dice"), F.lit(0).alias("end"))
        stop = F.least(start + F.col("most") - 1, F.size("before") - 1)
        return F.aggregate(F.sequence(start, stop), zero, step, lambda x: F.struct(start.alias("start"), x["end"].alias("end"), x["dice"].alias("dice")))

    runs = found.select("row", "doc_id", "license", F.explode(F.filter(F.transform("hits", best), lambda r: r["dice"] >= threshold)).alias("r")).select("row", "doc_id", "license", "r.*")
    single = {w: t.license for t in reversed(templates) for w in t.words if len(t.words) == 1}
    words = split.select("row", "doc_id", F.posexplode("w").alias("start", "g")).where(F.col("g").isin(list(single)))
    names = F.create_map(*[F.lit(x) for pair in (single or {"": ""}).items() for x in pair])
    alone = words.select("row", "doc_id", F.element_at(names, F.col("g")).alias("license"), "start", (F.col("start") + 1).alias("end"), F.lit(1.0).alias("dice"))
    return (runs.unionByName(alone) if single else runs).distinct()


def _best_runs(runs: DataFrame, longest: int) -> DataFrame:
    """The runs that no better one overlaps. They meet by stretches of a text as long as the longest run, so only near ones are compared."""
    order = F.struct(-F.col("dice"), F.col("start") - F.col("end"), "license", "start")
    runs = runs.withColumn("order", order).withColumn("stretch", F.floor(F.col("start") / longest))
    other = runs.select("row", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("order").alias("_order"), F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("stretch"))
    worse = (F.col("_order") < F.col("order")) & (F.col("_start") < F.col("end")) & (F.col("start") < F.col("_end"))
    r, o = runs.alias("r"), other.alias("o")
    return r.join(o, (F.col("r.row") == F.col("o.row")) & (F.col("r.stretch") == F.col("o.stretch")) & worse, "left_anti")
