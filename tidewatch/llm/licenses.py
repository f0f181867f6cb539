"""License scans: parts of texts compared to license templates by the Dice coefficient of their word bigrams.

Units are a text's lines, where it has several the whole text, and of each template runs of words: a run has as many words as the template, wherever
lines end, and begins where anchors of the template (below) have it begin, each by its place in the template. Of the beginnings that anchors vote for, those of
most votes come first, then the earlier ones, and each that lies no nearer to one before it than the template is long is compared, so every copy in a text is. A unit is
normalised (A-Z lower-cased; all but digits, letters and
characters beyond ASCII separates words) and stands for its set of word bigrams. It matches a template where
``2 |A and B| / (|A| + |B|)`` is at least ``LEAST_DICE``. A run is told where it beats the template's matching lines that it overlaps, and the whole text.

Bounds prune before any comparison, and lose nothing. Sizes must satisfy ``t / (2 - t) |B| <= |A| <= (2 - t) / t |B|``. At least ``t / (2 - t) |B|`` bigrams must be
shared, so any ``|B|`` less that number plus one of them hold one of every match's: the template's anchors, its longest ones, are so many. So a text without the longer word
of any anchor of any template matches nothing and is not looked at further, and one that shares too few bigrams with a template as a whole holds no match of it in any unit.

All of it is DataFrame functions within a row: nothing is exploded or shuffled, and a lost executor costs its rows alone.

Defined results: null and empty texts and one-word units match nothing; repeated rows stand for themselves; equal coefficients go to
the template whose id sorts first; an empty table gives no rows. :func:`scan` keeps all columns and replaces one named like its result.
"""

from __future__ import annotations

import json
import math
import pkgutil
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE = 0.8

# License notices and texts as their owners publish them.
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD
    + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. " + _BSD_TAIL,
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU "
        "General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": _MIT_BODY,
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
}

#: Whole texts, one file each, as published.
WHOLE_TEXTS = ("apache-2.0", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "mpl-2.0")
TEMPLATES |= {name: pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in WHOLE_TEXTS}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: str) -> list[str]:
    return [w for w in re.split(_BETWEEN, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def grams(text: str) -> list[str]:
    """Distinct word bigrams in order."""
    ws = normal_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:])))


def needed(n: int, least: float) -> int:
    """Of ``n`` bigrams, how many a match shares at least."""
    return math.ceil(least / (2 - least) * n - 1e-9)


def anchors(text: str, least: float) -> dict[str, int]:
    """Bigrams of which every match of a template holds one, and where each first stands: its longest, which are rare in prose."""
    ws, g = normal_words(text), grams(text)
    place: dict[str, int] = {}
    for i, (a, b) in enumerate(zip(ws, ws[1:])):
        place.setdefault(f"{a} {b}", i)
    chosen = sorted(g, key=lambda x: (-len(x), x))[: len(g) - needed(len(g), least) + 1]
    return {x: place[x] for x in sorted(chosen)}


def signs(text: str, least: float) -> set[str]:
    """Words of which every match of a template holds one: each anchor's longer word."""
    return {max(x.split(" "), key=len) for x in anchors(text, least)}


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    """Words of a lower-cased text, maybe with empty ones at its ends."""
    return F.split(text, _BETWEEN)


def _pairs(words: Column) -> Column:
    """Word bigrams in order, repeats included."""
    found = F.filter(words, lambda w: w != "")
    pair = lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1)))
    return _bound(found, pair)


_FOUND = "array<struct<unit:int,at:int,license:string,dice:double>>"


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "found", templates: dict[str, str] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """``docs`` with ``out_col``: matches as (``unit``: line from 1, 0 for the whole text, -1 for a run of words; ``at``: the run's first word,
    counted from 0, or -1; ``license``; ``dice``)."""
    templates = TEMPLATES if templates is None else templates
    rows = []
    for k, t in sorted(templates.items()):
        if g := grams(t):
            of = anchors(t, least)
            rows.append({"id": k, "n": len(g), "words": len(normal_words(t)), "grams": g, "needed": needed(len(g), least), "anchors": list(of), "places": list(of.values())})
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<id:string,n:int,words:int,grams:array<string>,needed:int,anchors:array<string>,places:array<int>>>")
    low, high = least / (2 - least), (2 - least) / least
    empty = F.lit(None).cast(_FOUND)
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)

    def dice(g: Column, t: Column) -> Column:
        return 2 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])

    def row(unit: Column, at: Column, t: Column, value: Column) -> Column:
        return F.struct(unit.cast("int").alias("unit"), at.cast("int").alias("at"), t["id"].alias("license"), value.alias("dice"))

    def of_unit(g: Column, unit: Column, near: Column) -> Column:
        """Matches of a line or the whole text."""
        fits = lambda t: (F.size(g) >= low * t["n"] - 1e-9) & (F.size(g) <= high * t["n"] + 1e-9)
        compared = F.transform(F.filter(near, fits), lambda t: row(unit, F.lit(-1), t, dice(g, t)))
        return F.filter(compared, lambda x: x["dice"] >= least)

    def runs_of(pairs: Column, distinct: Column, t: Column) -> Column:
        """The runs of a template's length that begin where its anchors have them begin."""
        begin = lambda x, i: F.greatest(i - F.element_at(t["places"], F.array_position(t["anchors"], x).cast("int")), F.lit(0))
        votes = lambda held: F.filter(F.transform(pairs, lambda x, i: F.when(F.array_contains(held, x), begin(x, i))), lambda i: i.isNotNull())
        counted = lambda vs: F.transform(F.array_distinct(vs), lambda s: F.struct((-F.size(F.filter(vs, lambda v: v == s))).alias("n"), s.alias("s")))
        ranked = lambda vs: F.transform(F.array_sort(counted(vs)), lambda x: x["s"])
        apart = lambda acc, s: F.when(F.exists(acc, lambda c: F.abs(c - s) < t["words"]), acc).otherwise(F.concat(acc, F.array(s)))
        begins = F.aggregate(_bound(_bound(F.array_intersect(distinct, t["anchors"]), votes), ranked), F.array().cast("array<int>"), apart)
        run = lambda i: F.array_distinct(F.slice(pairs, i + 1, F.greatest(t["words"] - 1, F.lit(0))))
        compared = F.transform(begins, lambda i: _bound(run(i), lambda g: F.struct(row(F.lit(-1), i, t, dice(g, t)).alias("told"), (i + t["words"]).alias("end"))))
        return F.filter(compared, lambda x: x["told"]["dice"] >= least)

    def with_near(near: Column, pairs: Column, distinct: Column) -> Column:
        lines = F.split(lower, "\n", -1)
        of_line = lambda line, i: _bound(F.array_distinct(_pairs(_words(line))), lambda g: F.when(F.size(g) > 0, of_unit(g, i + 1, near)).otherwise(F.array().cast(_FOUND)))
        whole = F.when(F.size(lines) > 1, of_unit(distinct, F.lit(0), near)).otherwise(F.array().cast(_FOUND))
        plain = F.concat(whole, F.flatten(F.transform(lines, of_line)))
        # Where the words of the first so many lines end.
        counts = F.transform(lines, lambda line: F.size(F.filter(_words(line), lambda w: w != "")))
        ends = F.aggregate(counts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

        def and_runs(told: Column) -> Column:
            def unbeaten(ends: Column) -> Column:
                covers = lambda y, x: (y["unit"] == 0) | ((F.get(ends, y["unit"] - 1) < x["end"]) & (x["told"]["at"] < F.get(ends, y["unit"])))
                beaten = lambda x: F.exists(told, lambda y: (y["license"] == x["told"]["license"]) & (y["dice"] >= x["told"]["dice"]) & covers(y, x))
                runs = F.flatten(F.transform(near, lambda t: runs_of(pairs, distinct, t)))
                return F.concat(told, F.transform(F.filter(runs, lambda x: ~beaten(x)), lambda x: x["told"]))

            return _bound(ends, unbeaten)

        return _bound(plain, and_runs)

    def with_pairs(pairs: Column) -> Column:
        near = lambda distinct: F.filter(known, lambda t: F.size(F.array_intersect(distinct, t["grams"])) >= t["needed"])
        inner = lambda distinct: _bound(near(distinct), lambda ts: F.when(F.size(ts) > 0, with_near(ts, pairs, distinct)))
        return _bound(F.array_distinct(pairs), inner)

    held = sorted(set().union(*(signs(t, least) for t in templates.values() if grams(t))))
    sign = F.from_json(F.lit(json.dumps(held)), "array<string>")
    found = _bound(_words(lower), lambda ws: F.when(F.arrays_overlap(ws, sign), _bound(_pairs(ws), with_pairs)).otherwise(empty))
    return docs.withColumn(out_col, F.coalesce(found, F.array().cast(_FOUND)))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_matches``, ``licenses`` (ids, sorted), ``best_license`` and ``best_dice``."""
    best = F.array_max(F.transform("found", lambda x: x["dice"]))
    return found.select(
        F.col(id_col).alias("doc_id"),
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))), ",").alias("licenses"),
        F.array_min(F.transform(F.filter("found", lambda x: x["dice"] == best), lambda x: x["license"])).alias("best_license"),
        F.round(best, 6).alias("best_dice"),
    )


def oracle_sql(least: float = LEAST_DICE) -> str:
    """The same in DuckDB's SQL, by plain comparison of every unit with every template."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"('{k}', {quoted(t)})" for k, t in TEMPLATES.items())
    placed = ", ".join(f"('{k}', {quoted(x)}, {i})" for k, t in TEMPLATES.items() for x, i in anchors(t, least).items())
    words = f"list_filter(string_split(regexp_replace(translate(unit, '{_UPPER}', '{_LOWER}'), '{_BETWEEN}', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS text FROM documents),
units AS (SELECT doc_id, i, lines[i] AS unit FROM texts, unnest(range(1, len(lines) + 1)) AS t(i)
  UNION ALL SELECT doc_id, 0, text FROM texts WHERE len(lines) > 1),
grams AS MATERIALIZED (SELECT doc_id, i, len(ws) AS n, list_distinct({pairs}) AS g FROM (SELECT doc_id, i, {words} AS ws FROM units)),
spans AS (SELECT doc_id, i, CASE WHEN i = 0 THEN 0 ELSE sum(CASE WHEN i > 0 THEN n ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - n END AS off, n FROM grams),
templates AS MATERIALIZED (SELECT license, list_distinct({pairs}) AS t, len(ws) AS m FROM (SELECT license, {words} AS ws FROM (VALUES {rows}) AS v(license, unit))),
plain AS (SELECT doc_id, i, license, 2 * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice
  FROM grams, templates WHERE len(g) > 0 AND len(g) BETWEEN 0.5 * len(t) AND 2 * len(t) AND list_has_any(g, t)),
told AS (SELECT doc_id, license, dice, off, n FROM plain JOIN spans USING (doc_id, i) WHERE dice >= {least}),
anchors(license, gram, place) AS (VALUES {placed}),
whole AS MATERIALIZED (SELECT doc_id, {pairs} AS g FROM (SELECT doc_id, {words} AS ws FROM (SELECT doc_id, text AS unit FROM texts))),
votes AS MATERIALIZED (SELECT doc_id, license, greatest(i - 1 - place, 0) AS s, count(*) AS n FROM (SELECT doc_id, g[i] AS gram, i FROM whole, unnest(range(1, len(g) + 1)) AS t(i)) JOIN anchors USING (gram) GROUP BY ALL),
picked AS (
  SELECT doc_id, license, []::BIGINT[] AS chosen, CAST(NULL AS BIGINT) AS s FROM (SELECT DISTINCT doc_id, license FROM votes)
  UNION ALL SELECT doc_id, license, list_append(any_value(chosen), arg_min(s, (-n, s))), arg_min(s, (-n, s))
  FROM (SELECT p.doc_id, p.license, p.chosen, v.s, v.n FROM picked p JOIN votes v USING (doc_id, license) JOIN templates t USING (license) WHERE len(list_filter(p.chosen, lambda c: abs(c - v.s) < t.m)) = 0)
  GROUP BY doc_id, license),
runs AS (SELECT doc_id, license, s, m, list_distinct(list_slice(g, s + 1, s + m - 1)) AS r, t FROM picked JOIN whole USING (doc_id) JOIN templates USING (license) WHERE s IS NOT NULL),
compared AS (SELECT doc_id, license, s, m, 2 * len(list_intersect(r, t)) / (len(r) + len(t)) AS dice FROM runs),
met AS (SELECT doc_id, license, dice FROM told UNION ALL SELECT doc_id, license, dice FROM compared c WHERE dice >= {least}
  AND NOT EXISTS (FROM told WHERE told.doc_id = c.doc_id AND told.license = c.license AND told.dice >= c.dice AND told.off < c.s + c.m AND c.s < told.off + told.n)),
best AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
  arg_min(license, (-dice, license)) AS best_license, max(dice) AS dice FROM met GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, round(dice, 6) AS best_dice
FROM documents d LEFT JOIN best USING (doc_id)
"""
