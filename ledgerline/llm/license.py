"""License scans: texts compared to licence templates by Dice coefficient over word bigrams, in SQL functions only.

A text is normalised (A-Z in lower case; anything but a-z, 0-9 and line ends is a space). Its units are compared with a
template: the whole text, every paragraph, every line, and a window of as many words as the template has from the
start of every line and every sentence, over line and paragraph ends. A unit with bigram set U matches a template with
set T when 2 |U and T| / (|U| + |T|) >= threshold. Two bounds prune without losing a match: U and T can differ in size by
the factor threshold / (2 - threshold) at most; and as a match holds at least that share of T's bigrams, it holds
a word of any word list that touches more of T's bigrams than may be missing. Such a list of long words is derived
from each template, and regular expressions of them pick the texts and units that are split into bigrams at all.

Defined results: null texts, texts without words and units of one word match nothing; equal units of one text
count once; ties are broken by template name; repeated rows get equal results; an empty table gives an empty
result; extra columns are ignored. Whole texts are scanned. Templates are literals, so nothing is joined.
"""

from __future__ import annotations

import math
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices and texts of public licences.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
    "MIT-line": "Released under the MIT License.",
    "MIT-line-2": "This software is licensed under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
        TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
        SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
        from any source distribution.""",
    "BSL-1.0-line": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or
        copy at http://www.boost.org/LICENSE_1_0.txt)""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "LGPL-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version.""",
    "AGPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-line": "Licensed under CC BY-NC 4.0.",
    "CC0-line": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "Copyright. All rights reserved.",
}
#: Words that are in much prose; a template's list takes others first.
COMMON = frozenset("a all an and any are as at be by for from in is not of on or that the this to under with".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: str) -> str:
    return " ".join(re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(_UPPER, _LOWER))).split())


def bigrams(text: str) -> set[str]:
    words = normal(text).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def needed_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every match of any template holds one."""
    out: set[str] = set()
    for text in templates.values():
        grams = bigrams(text)
        missing = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (w not in out, w in COMMON, -len(w), w))
        mine: set[str] = set()
        for w in words:
            if sum(bool(mine & set(g.split())) for g in grams) > missing:
                break
            mine.add(w)
        out |= mine
    return sorted(out)


def _trie(words: list[str]) -> str:
    """A regular expression of the words that reads common beginnings once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(first + (rest[0] if len(rest) == 1 else f"(?:{_trie(rest)})" if all(rest) else f"(?:{'|'.join(sorted(rest, key=len, reverse=True))})") for first, rest in sorted(by.items()))


#: Stands before the first word of every line and every sentence.
MARK = "|"


def _marked(text: Column) -> Column:
    """All words of the text, with MARK where a line or a sentence starts; marks without a word are left out."""
    lines = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "([.!?]) ", "$1\n")
    clean = F.regexp_replace(F.regexp_replace(lines, "[^a-z0-9\n]+", " "), " *(?:\n *)+", " | ")
    return F.split(F.concat(F.lit("| "), F.trim(clean, F.lit("| "))), " ")


def _units(text: Column) -> Column:
    """The normalised text as a whole, its paragraphs and its lines, once each."""
    clean = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9\n]+", " ")
    tidy = lambda x: F.trim(F.regexp_replace(x, "[ \n]+", " "))
    paragraphs = F.transform(F.split(clean, "\n *\n"), tidy)
    lines = F.transform(F.split(clean, "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.concat(F.array(tidy(clean)), paragraphs, lines))


def templates_from(folder: str) -> dict[str, str]:
    """Further templates for matches(): every file of a folder on the driver, as full licence texts are shipped with systems."""
    found = {}
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            found[name] = f.read()
    return found


def _bounds(size: int, threshold: float) -> tuple[int, int]:
    """The least and the most bigrams of a unit that can match a template of the given size."""
    low = threshold / (2 - threshold)
    return math.ceil(size * low - 1e-9), math.floor(size / low + 1e-9)


def _grams(words: str) -> str:
    """SQL for the distinct bigrams of an array of words; null for fewer than two. Named once in it, words is read once."""
    pairs = "zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat_ws(' ', a, b))"
    return f"transform({words}, w -> CASE WHEN size(w) > 1 THEN array_distinct({pairs}) END)"


def _hits(grams: str, names: dict[str, str], threshold: float) -> list[str]:
    """SQL for the matches of an array of bigram sets with each template; the sets' sizes are checked first."""
    out = []
    for name, text in names.items():
        t = sorted(bigrams(text))
        low, high = _bounds(len(t), threshold)
        dice = f"2.0D * size(array_intersect(g, split('{'|'.join(t)}', '[|]'))) / (size(g) + {len(t)})"
        hit = f"named_struct('license', '{name}', 'dice', CASE WHEN size(g) BETWEEN {low} AND {high} THEN {dice} END)"
        out.append(f"filter(transform({grams.replace('WIDTH', str(len(normal(text).split())))}, g -> {hit}), h -> h.dice >= {threshold}D)")
    return out


def matches(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license and dice of every unit and template that match."""
    templates = {name.replace("'", " "): text for name, text in sorted((templates or TEMPLATES).items()) if bigrams(text)}
    every = _trie(needed_words(templates, threshold))
    hint = f"(?:^| )(?:{every})(?: |$)"
    docs = docs.where(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{every})(?![a-z0-9])"))
    # units that the text's own form gives, and the words with the places where lines and sentences start
    own = F.filter(_units(F.col("text")), lambda x: x.rlike(hint))
    starts = F.expr(f"filter(sequence(1, size(marked)), i -> element_at(marked, i) = '{MARK}')")
    at = docs.select("doc_id", "text", own.alias("units"), _marked(F.col("text")).alias("marked")).withColumn("starts", starts)
    at = at.withColumn("grams", F.expr(f"filter({_grams("transform(units, u -> split(u, ' '))")}, g -> g IS NOT NULL)"))
    found = _hits("grams", templates, threshold)
    # windows of a template's length, only those with a word that the template needs
    window = f"transform(starts, i -> slice(filter(slice(marked, i + 1, 2 * WIDTH), x -> x <> '{MARK}'), 1, WIDTH))"
    for name, text in templates.items():
        needed = needed_words({name: text}, threshold)
        some = f"filter({window}, w -> exists(w, x -> x IN ({', '.join(map(repr, needed))})))"
        found.append(f"CASE WHEN text RLIKE r'(?i)(?<![a-z0-9])(?:{_trie(needed)})(?![a-z0-9])' THEN {_hits(_grams(some), {name: text}, threshold)[0]} END")
    hits = F.expr(f"flatten(filter(array({', '.join(found)}), x -> x IS NOT NULL))")
    return at.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.license", "hit.dice")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, n_units and best dice of every document and template that match."""
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_units"), F.max("dice").alias("dice"))


def oracle() -> str:
    """The query in DuckDB's SQL, without the pruning by words."""
    rows = ", ".join(f"('{name}', {sorted(bigrams(text))!r}, {len(normal(text).split())})" for name, text in sorted(TEMPLATES.items()))
    return f"""
    WITH templates(license, t, width) AS (VALUES {rows}),
    clean AS (SELECT doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS low, regexp_replace(low, '[^a-z0-9\\n]+', ' ', 'g') AS c FROM documents WHERE text IS NOT NULL),
    parts AS (
        SELECT doc_id, list_distinct([trim(regexp_replace(c, '[ \\n]+', ' ', 'g'))]
            || list_transform(regexp_split_to_array(c, '\\n *\\n'), lambda x: trim(regexp_replace(x, '[ \\n]+', ' ', 'g')))
            || list_transform(string_split(c, chr(10)), lambda x: trim(x))) AS units FROM clean),
    unit AS (SELECT doc_id, string_split(unnest(units), ' ') AS w FROM parts),
    grams AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM unit WHERE len(w) > 1),
    marked AS (
        SELECT doc_id, string_split('| ' || trim(regexp_replace(regexp_replace(regexp_replace(low, '([.!?]) ', '\\1' || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' *(\\n *)+', ' | ', 'g'), '| '), ' ') AS m
        FROM clean WHERE regexp_matches(low, '({"|".join(needed_words(TEMPLATES, THRESHOLD))})')),
    starts AS (SELECT doc_id, m, unnest(list_filter(range(1, len(m) + 1), lambda i: m[i] = '|')) AS s FROM marked),
    cut AS (SELECT doc_id, license, t, list_filter(m[s + 1 : s + 2 * width], lambda x: x <> '|')[1 : width] AS w FROM starts, templates),
    windows AS (SELECT doc_id, license, t, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM cut WHERE 3 * len(w) >= 2 * len(t)),
    pairs AS (
        SELECT doc_id, license, t, g FROM grams, templates WHERE len(g) * 1.5 >= len(t) AND len(g) <= len(t) * 1.5 + 1
        UNION ALL SELECT doc_id, license, t, g FROM windows WHERE len(g) * 1.5 >= len(t) AND len(g) <= len(t) * 1.5 + 1),
    scored AS (SELECT doc_id, license, CAST(2 AS DOUBLE) * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice FROM pairs)
    SELECT doc_id, license, count(*) AS n_units, max(dice) AS dice FROM scored WHERE dice >= {THRESHOLD} GROUP BY doc_id, license
    """
