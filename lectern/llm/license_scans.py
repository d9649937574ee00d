"""Licence notices found by Dice coefficient over word bigrams.

Texts and templates are normalised alike: lower case, and every run of other characters than letters
and digits becomes a blank, so wrapping, comment signs and quotes do not matter. Wherever a text and a template share a
bigram, the text's words are laid beside the template's: the window of as many words as the template has, aligned at
that bigram (cut at the text's ends), is compared. It matches if twice the number of distinct bigrams both hold is at least
``threshold`` times the sum of their numbers of distinct bigrams.

Two exact bounds prune. A window matches only if the number of its distinct bigrams lies between ``t / (2 - t)`` and
``(2 - t) / t`` times the template's. And a match shares at least ``t / (2 - t)`` of the template's bigrams, so it holds one of any words
that cover the others: a text without any of these few words (chosen when the templates are read) is not cut at all.

One projection of each row: no shuffle, and nothing grows with the corpus.

Defined results: null or empty text and a text of one word have no bigrams and match nothing; very long texts are read
whole; rows that repeat are scanned each on their own; ties go to the template that is listed first; a null ``doc_id``
stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.native import let

#: Notices under which texts and programs are usually licensed.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Apache-2.0-conditions": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "Apache-2.0-text": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "GPL-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
}

RESULT = "doc_id, n_matches, license_id, dice, licenses"


def words_of(text: str) -> list[str]:
    """Normalised words of a template."""
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    """Distinct bigrams of a normalised template, in order."""
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bounds(size: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams that a window may have to match a template of ``size``; a match shares at least the lower one."""
    ratio = threshold / (2 - threshold)
    return math.ceil(size * ratio - 1e-9), int(size / ratio + 1e-9)


#: Words of any text, which prune nothing; needed only where no others cover a template.
COMMON = frozenset("a an and any as at be by for from in is it no not of on or that the this to under use was with".split())


def needed_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words one of which stands in every match: of each template, its longest words until the others cover too few bigrams."""
    found: dict[str, None] = {}
    for text in templates.values():
        left = bigrams_of(text)
        fewest = _bounds(len(left), threshold)[0]
        for word in sorted({*words_of(text)}, key=lambda x: (x in COMMON, x not in found, -len(x), x)):
            if len(left) < fewest or not left:
                break
            found[word] = None
            left = [g for g in left if word not in g.split()]
    return sorted(found)


def _matches(words: Column, grams: Column, listed: list[tuple[int, str, list[str], list[str]]], threshold: float) -> Column:
    """(dice, -place, id) of the best window of each template that matches."""
    n = F.size(words)
    some = []
    for k, name, of, distinct in listed:
        low, high = _bounds(len(distinct), threshold)
        places: dict[str, list[int]] = {}
        for i, (x, y) in enumerate(zip(of, of[1:], strict=False)):
            places.setdefault(f"{x} {y}", []).append(i)

        def starts() -> Column:
            """First words of the windows, some of them before the text."""
            by_gram = F.array(*[F.array(*map(F.lit, places[g])) for g in distinct])
            hit = F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("i"), F.array_position(F.lit(distinct), g).cast("int").alias("g"))), lambda x: x["g"] > 0)
            return F.array_distinct(F.flatten(F.transform(hit, lambda x: F.transform(F.get(by_gram, x["g"] - 1), lambda o: x["i"] - o))))

        def dice(start: Column) -> Column:
            first = F.greatest(start, F.lit(0))
            last = F.least(start + len(of), n) - 2  # the last bigram's first word
            window = F.array_distinct(F.slice(grams, first + 1, F.greatest(last - first + 1, F.lit(0))))
            value = 2.0 * F.size(F.array_intersect(window, F.lit(distinct))) / (F.size(window) + len(distinct))
            return F.when(F.size(window).between(low, high), value).otherwise(F.lit(0.0))

        best = F.array_max(F.transform(starts(), dice))
        some.append(let(best, lambda d: F.when(d >= threshold, F.struct(F.round(d, 6).alias("dice"), F.lit(-k).alias("k"), F.lit(name).alias("id")))))
    return F.array_compact(F.array(*some))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Licence matches of each document of ``docs`` (doc_id, text).

    Returns n_matches (templates that match), license_id and dice of the best match (null without
    one), and licenses, the ids of all matched templates, sorted and joined by commas.
    """
    listed = [(k, n, words_of(t), bigrams_of(t)) for k, (n, t) in enumerate(templates.items()) if len(words_of(t)) > 1]
    none = F.array().cast("array<struct<dice:double,k:int,id:string>>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    needed = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, needed_words(templates, threshold)))})(?![\p{{L}}\p{{N}}])"
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    cut = let(F.split(_normalised(text), " "), lambda w: F.when(F.size(w) > 1, let(grams(w), lambda g: _matches(w, g, listed, threshold))).otherwise(none))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.when(F.lower(text).rlike(needed), cut).otherwise(none) if listed else none).alias("found"))
    best = F.array_max("found")
    names = F.array_join(F.array_sort(F.transform("found", lambda x: x["id"])), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_matches"), best["id"].alias("license_id"), best["dice"].alias("dice"), names.alias("licenses"))


def oracle_sql(templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same in DuckDB SQL: windows by a join of all bigrams, without the words that prune."""
    listed = [(k, n, words_of(t), bigrams_of(t)) for k, (n, t) in enumerate(templates.items())]
    rows = ",\n".join(f"({k}, '{n}', {len(w)}, [{', '.join(repr(g) for g in grams)}])" for k, n, w, grams in listed)
    places = ",\n".join(f"({k}, {i}, '{x} {y}')" for k, _, w, _ in listed for i, (x, y) in enumerate(zip(w, w[1:], strict=False)))
    return f"""
WITH t(k, id, size, grams) AS (VALUES {rows}),
p(k, o, gram) AS (VALUES {places}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT row_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM d WHERE len(w) > 1),
spot AS (SELECT row_id, unnest(b) AS gram, unnest(range(0, len(b))) AS i FROM g),
starts AS (SELECT DISTINCT row_id, k, i - o AS start FROM spot JOIN p USING (gram)),
win AS (SELECT row_id, t.k, id, grams, list_distinct(b[greatest(start, 0) + 1:least(start + size, len(b) + 1) - 1]) AS x FROM starts JOIN t USING (k) JOIN g USING (row_id)),
m AS (SELECT row_id, k, id, max(2.0 * len(list_intersect(x, grams)) / (len(x) + len(grams))) AS dice FROM win GROUP BY row_id, k, id),
best AS (SELECT row_id, count(*) AS n, arg_max(id, (round(dice, 6), -k)) AS id, max(round(dice, 6)) AS dice, string_agg(id, ',' ORDER BY id) AS ids FROM m WHERE dice >= {threshold} GROUP BY row_id)
SELECT doc_id, coalesce(n, 0) AS n_matches, id AS license_id, dice, coalesce(ids, '') AS licenses FROM d LEFT JOIN best USING (row_id)
"""
