"""Licence texts and notices in documents, by the Dice coefficient of word bigrams."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import read_table

DICE = 0.8
# Licence notices and the opening paragraphs of licence texts.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", 'MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
)


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def templates_by_size(dice: float = DICE) -> list[tuple[int, int]]:
    """(size, number): each template at every size of a set that can reach the coefficient.

    2 min(a, b) / (a + b) bounds the coefficient, so a set of a bigrams needs a between
    b dice / (2 - dice) and b (2 - dice) / dice. The table has a fixed number of rows.
    """
    rows = []
    for number, (_, text) in enumerate(TEMPLATES):
        b = len(bigrams(text))
        rows += [(a, number) for a in range(1, 3 * b) if 2 * min(a, b) / (a + b) >= dice]
    return rows


# Words too common to tell a licence by.
COMMON = frozenset("a all an and any are as at be by can for from has if in is it may must no not obtain of on or see so that the this to under use was where which with without you".split())


def anchors(dice: float = DICE) -> list[str]:
    """Words of which every text that reaches the coefficient has at least one.

    Such a text shares at least dice / (2 - dice) of a template's bigrams. So if the bigrams that hold a
    chosen word are more than the others may be missing, one of the words is in it. Words that hold the most
    bigrams are chosen first, and from the whole template's words only if the uncommon ones don't suffice.
    """
    chosen: set[str] = set()
    for _, text in TEMPLATES:
        grams = [g.split() for g in bigrams(text)]
        enough = len(grams) - math.ceil(len(grams) * dice / (2 - dice) - 1e-9) + 1
        held = lambda words: sum(1 for g in grams if not words.isdisjoint(g))
        words = sorted({w for g in grams for w in g})
        for pool in ([w for w in words if w not in COMMON and len(w) > 1], words):
            while held(chosen) < enough and (left := [w for w in pool if w not in chosen]):
                chosen.add(max(left, key=lambda w: (held(chosen | {w}), len(w), w)))
    return sorted(chosen)


#: Turn a text into units: line ends or the gaps between paragraphs, which hold no word, and sentence ends; then only words and spaces are left.
_LINES = r"[^a-z0-9\n]+"
_SENTENCE = r"([.!?;])\s+"
_GAP = r"\n[^a-z0-9]*\n"
_PARAGRAPHS = r"[^a-z0-9\x01]+"


def scan(docs: DataFrame, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licence, n_units, dice, words): the licences found in each row's text.

    Units are the lines, the sentences of lines, the paragraphs, the sentences of paragraphs across their lines, and the whole of a
    text, in lower case and without punctuation, so that comment marks and wrapping make no difference; equal units of a text count once. Each is compared with the templates whose size admits the coefficient
    and goes to the best one (on a tie the first in TEMPLATES). A row counts for its number of units, best
    coefficient and the words of the largest unit. Texts without a licence, and null or empty texts, give no
    row. Rows with the same id count together; a null id is an id. Other columns of docs are not read.

    Texts and units without any of the words in anchors() can't reach the coefficient and are passed over.
    The templates are a fixed table and are broadcast; documents are grouped within themselves, so what is
    shuffled are the units found alone.
    """
    spark = docs.sparkSession
    sized = spark.createDataFrame(templates_by_size(dice), "size int, number int")
    table = spark.createDataFrame([(k, licence, bigrams(text)) for k, (licence, text) in enumerate(TEMPLATES)], "number int, licence string, grams array<string>")
    low, high = min(r[0] for r in templates_by_size(dice)), max(r[0] for r in templates_by_size(dice))
    # A bigram set of size a has at least a + 1 words; repeated bigrams only add words.
    has_anchor = f"(?<![a-z0-9])(?:{'|'.join(anchors(dice))})(?![a-z0-9])"
    docs = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).where(F.col("text").rlike(has_anchor))
    text = F.col("text")
    lines = F.split(F.regexp_replace(text, _LINES, " "), "\n")
    parts = F.split(F.regexp_replace(F.regexp_replace(text, _SENTENCE, "$1\n"), _LINES, " "), "\n")
    whole = F.array(F.regexp_replace(text, "[^a-z0-9]+", " "))
    gaps = F.regexp_replace(text, _GAP, "\x01")
    paragraphs = F.split(F.regexp_replace(gaps, _PARAGRAPHS, " "), "\x01")
    across = F.split(F.regexp_replace(F.regexp_replace(gaps, _SENTENCE, "$1\x01"), _PARAGRAPHS, " "), "\x01")
    units = F.array_distinct(F.transform(F.concat(lines, parts, paragraphs, across, whole), lambda u: F.trim(u)))
    n_spaces = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    units = F.filter(units, lambda u: (F.length(u) >= 2 * low + 1) & (n_spaces(u) >= low) & u.rlike(has_anchor))
    rows = docs.select("doc_id", F.explode(units).alias("unit"))
    rows = rows.withColumn("words", F.split("unit", " "))
    pairs = F.array_distinct(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.concat_ws(" ", a, b)))
    rows = rows.select("doc_id", "unit", F.size("words").alias("n_words"), pairs.alias("pairs")).withColumn("size", F.size("pairs"))
    rows = rows.where(F.col("size").between(low, high))
    both = rows.join(F.broadcast(sized), "size").join(F.broadcast(table), "number")
    likeness = 2 * F.size(F.array_intersect("pairs", "grams")) / (F.size("pairs") + F.size("grams"))
    both = both.withColumn("dice", likeness).where(F.col("dice") >= dice)
    best = both.groupBy("doc_id", "unit").agg(F.max(F.struct("dice", (-F.col("number")).alias("order"), "licence", "n_words")).alias("best"))
    return (
        best.groupBy(F.col("doc_id").alias(id_col), F.col("best.licence").alias("licence"))
        .agg(F.count("*").alias("n_units"), F.max("best.dice").alias("dice"), F.max("best.n_words").cast("int").alias("words"))
    )


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op1_sql() -> str:
    """The same over the table documents, for DuckDB."""
    sized = templates_by_size()
    low, high = min(r[0] for r in sized), max(r[0] for r in sized)
    sizes = ", ".join(f"({a}, {n})" for a, n in sized)
    values = ", ".join(f"({n}, '{licence}', [{', '.join(repr(g) for g in bigrams(text))}])" for n, (licence, text) in enumerate(TEMPLATES))
    return f"""
WITH sized(size, number) AS (VALUES {sizes}),
templates(number, licence, grams) AS (VALUES {values}),
lowered AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
texts AS (SELECT doc_id, t, regexp_replace(t, '\\n[^a-z0-9]*\\n', chr(1), 'g') AS gaps FROM lowered),
units AS (
  SELECT DISTINCT doc_id, trim(unit) AS unit FROM (
    SELECT doc_id, unnest(string_split(regexp_replace(t, '[^a-z0-9\n]+', ' ', 'g'), chr(10))) AS unit FROM texts
    UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(t, '([.!?;])\\s+', '\\1' || chr(10), 'g'), '[^a-z0-9\n]+', ' ', 'g'), chr(10))) FROM texts
    UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(gaps, '[^a-z0-9\\x01]+', ' ', 'g'), chr(1))) FROM texts
    UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(gaps, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g'), chr(1))) FROM texts
    UNION ALL SELECT doc_id, regexp_replace(t, '[^a-z0-9]+', ' ', 'g') FROM texts)),
split AS (SELECT doc_id, unit, string_split(unit, ' ') AS words FROM units WHERE length(unit) >= {2 * low + 1}),
paired AS (
  SELECT doc_id, unit, len(words) AS n_words, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pairs
  FROM split WHERE len(words) > {low}),
scored AS (
  SELECT doc_id, unit, n_words, number, licence, 2 * len(list_intersect(pairs, grams)) / (len(pairs) + len(grams)) AS dice
  FROM paired JOIN sized ON len(pairs) = size JOIN templates USING (number) WHERE len(pairs) BETWEEN {low} AND {high}),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, number) AS place FROM scored WHERE dice >= {DICE})
SELECT doc_id, licence, count(*) AS n_units, max(dice) AS dice, CAST(max(n_words) AS INTEGER) AS words
FROM best WHERE place = 1 GROUP BY doc_id, licence"""
