"""Licence scan by the Dice coefficient over word bigrams.

Units of a text (its lines, its blocks between blank lines, the whole text) are
normalised and compared with licence templates: 2 |A n B| / (|A| + |B|) over the
sets of word bigrams.  A coefficient of ``t`` needs t / (2 - t) <= |A| / |B| <=
(2 - t) / t, which prunes templates by size, and shares so many bigrams that one
of a template's few telling words must occur, which prunes texts before any
bigram is built.  Both prunings are exact.

Native and local to the row: no shuffle, no join; the templates are constants of
the plan.

Defined cases: null or empty texts and units with fewer than two words match
nothing; a unit that fits several templates gets the best, on a tie the first by
name; blocks and the whole text are only reported where they differ from a line;
equal rows are reported each; other columns are not returned.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurewatch.functions.common import sealed

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Texts and the one-line notices in common use.
TEMPLATES = {
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under
the License.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details. You should have received a copy of the GNU General Public License along
with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": _ISC,
    "MIT": _MIT,
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Proprietary notice": "All rights reserved.",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.""",
}
# Words too common to tell a licence.
COMMON = set("""a an and any are as at be by for free from if in into is it may no not of on or other out see shall so
such that the this to under use was where whether with without work you your version all above following 0 1 2 3 4
nc sa""".split())


def _bigrams(text: str) -> set[str]:
    words = re.findall(r"[^\W_]+", text.lower().replace("licence", "license"))
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def telling_words(templates: dict[str, str], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that reaches the threshold with some template holds one.

    A match shares at least t / (2 - t) of a template's bigrams; words are chosen
    until fewer bigrams than that are without a chosen word.
    """
    chosen: set[str] = set()
    for text in templates.values():
        grams = _bigrams(text)
        needed = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
        bare = {g for g in grams if not chosen & set(g.split())}
        while len(bare) >= needed:
            count = {}
            for g in bare:
                for w in set(g.split()):
                    count[w] = count.get(w, 0) + 1
            best = min(count, key=lambda w: (w in COMMON, -count[w], w))
            chosen.add(best)
            bare = {g for g in bare if best not in g.split()}
    return sorted(chosen)


def normalised(text: Column) -> Column:
    """Lower case, one spelling of licence, words of letters and digits with single spaces."""
    spelled = F.replace(F.lower(text), F.lit("licence"), F.lit("license"))
    return F.trim(F.regexp_replace(spelled, "[^\\p{L}\\p{N}]+", " "))


def _strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def scan_licences(docs: DataFrame, key="doc_id", text="text", templates: dict[str, str] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """One row per unit that matches: doc_id, unit (line, block or text), its number, licence, dice."""
    templates = TEMPLATES if templates is None else templates
    grams = {name: sorted(_bigrams(t)) for name, t in sorted(templates.items())}
    grams = {name: g for name, g in grams.items() if g}
    words = telling_words({n: templates[n] for n in grams}, threshold)
    tells = f"(?<![a-z])(?:{'|'.join(map(re.escape, words))})" if words else "(?!)"
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.filter(F.replace(F.lower(F.col("text")), F.lit("licence"), F.lit("license")).rlike(tells))
    lines, blocks = F.split(body, "\n", -1), F.split(body, "\n[ \\t\\r]*\n", -1)
    listed = lambda kind, parts: F.transform(parts, lambda x, i: F.struct(
        F.lit(kind).alias("unit"), i.alias("number"), x.alias("words")))
    none = F.slice(listed("text", F.array(body)), 1, 0)
    units = F.concat(listed("line", lines),
                     F.when(F.size(blocks) > 1, F.filter(listed("block", blocks), lambda u: F.contains(u.words, F.lit("\n"))))
                     .otherwise(none),
                     F.when(F.size(lines) > 1, listed("text", F.array(body))).otherwise(none))
    # sealed columns: computed once, not copied by the optimizer into each use
    where = ["doc_id", "unit", "number"]
    rows = sealed(rows.select("doc_id", F.explode(units).alias("u")),
                  ["doc_id", "u.unit", "u.number"], {"words": normalised(F.col("u.words"))})
    rows = sealed(rows.filter(F.col("words").rlike(tells)), where, {"parts": F.split("words", " ")})
    grams_of = F.transform(F.slice("parts", 1, F.size("parts") - 1),
                           lambda w, i: F.concat(w, F.lit(" "), F.get("parts", i + 1)))
    rows = sealed(rows.filter(F.size("parts") > 1), where, {"own": F.array_distinct(grams_of)})
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    smallest, largest = min(map(len, grams.values()), default=0), max(map(len, grams.values()), default=0)
    size = F.size("own")
    rows = rows.filter((size >= low * smallest - 1e-9) & (size <= high * largest + 1e-9))
    constants = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(len(g)).alias("n"), _strings(g).alias("grams"))
                          for name, g in grams.items()])
    fitting = F.filter(constants, lambda t: (size >= low * t.n - 1e-9) & (size <= high * t.n + 1e-9))
    best = F.array_min(F.transform(fitting, lambda t: F.struct(
        (F.lit(-2.0) * F.size(F.array_intersect("own", t.grams)) / (size + t.n)).alias("minus"), t.licence.alias("licence"))))
    rows = sealed(rows, where, {"best": best}) if grams else rows.limit(0).withColumn(
        "best", F.lit(None).cast("struct<minus:double,licence:string>"))
    return rows.filter(F.col("best.minus") <= -threshold).select(
        "doc_id", "unit", "number", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("dice"))


def op5_licence_scan(spark, sf_dir):
    """Licence notices and texts in every document."""
    from lurewatch.llm.common import documents
    return scan_licences(documents(spark, sf_dir))


def oracle(templates=TEMPLATES) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, sorted(_bigrams(t))))}])" for n, t in templates.items())
    return rf"""
WITH t(licence, grams) AS (VALUES {rows}),
u AS (SELECT doc_id, 'line' AS unit, unnest(range(len(l))) AS number, unnest(l) AS body
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
  UNION ALL SELECT doc_id, 'block', n, body FROM (SELECT doc_id, unnest(range(len(b))) AS n, unnest(b) AS body
      FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS b FROM documents) WHERE len(b) > 1) WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM documents WHERE contains(text, chr(10))),
w AS (SELECT doc_id, unit, number, string_split(trim(regexp_replace(replace(lower(body), 'licence', 'license'),
      '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS p FROM u),
g AS (SELECT doc_id, unit, number, list_distinct(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) AS own
      FROM w WHERE len(p) > 1),
d AS (SELECT doc_id, unit, number, licence,
      2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice
      FROM g JOIN t ON len(own) BETWEEN 0.6 * len(grams) AND 1.6 * len(grams))
SELECT doc_id, unit, number::INT AS number, licence, dice FROM d WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, licence) = 1"""
