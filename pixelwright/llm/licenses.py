"""License scans: normalised text against license templates by the Dice coefficient.

Units and templates are lower-cased and cut into words of letters and digits; their size is the
number of word bigrams, repeats counted. Dice = 2 * shared / (size + size), shared bigrams with
the smaller of both counts. The units of a document are

* its lines, numbered from 1, and, if there are several, the whole document, number 0;
* for each template, the windows of as many bigrams as the template has over the whole text,
  lines joined, that start at a bigram of the template, or at the last place for a window if that
  comes first; their number is minus the place of their first bigram, from 1. So a notice is
  found within a line of prose, and a license text however its lines are wrapped.

DataFrame functions only; all prunings are exact:

* Size bounds: Dice >= t needs t / (2 - t) <= size of unit / size of template <= (2 - t) / t.
* Dice >= t also needs t / (2 - t) of the template's bigrams, so at least one of any larger
  set than the rest: the anchors. A document without any anchor has no match.
* A window needs t of the template's bigrams, so its first and last of so many hits lie within
  the template's size; other windows are not scored.
* Templates are a parameter of fixed size, so they are broadcast.

Cases: null or empty text, or a unit of fewer than two words, has no bigram and never matches;
repeated rows each count; of equal Dice values in a document a line or the whole document is
reported before a window, then the least number without sign; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, table

THRESHOLD = 0.8

#: Short notices, headers and texts of public licenses (the long ones without their copyright lines).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-long-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Public-domain", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)


def words(text: str) -> list[str]:
    """A template's words; the SQL side normalises documents by the same rule."""
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> Counter[str]:
    w = words(text)
    return Counter(f"{a} {b}" for a, b in zip(w, w[1:]))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The least and the most bigrams of a unit that can match a template of this size; whole numbers, as floats round 6 * 0.8 / 1.2 above 4."""
    t = Fraction(str(threshold))
    return math.ceil(size * t / (2 - t)), math.floor(size * (2 - t) / t)


def anchors(templates: Iterable[tuple[str, str]], threshold: float) -> list[str]:
    """For each template enough bigrams that any match has one of them; long words first, as they are rare."""
    out: set[str] = set()
    for _, text in templates:
        counts = bigrams(text)
        size = sum(counts.values())
        spare = size - bounds(size, threshold)[0]  # a match may lack so many
        gathered = 0
        for gram in sorted(counts, key=lambda g: (-len(g), g)):
            if gathered > spare:
                break
            out.add(gram)
            gathered += counts[gram]
    return sorted(out)


def any_of(grams: list[str]) -> str:
    """A pattern that finds one of the bigrams, blanks around it: a tree of their letters, so that little is tried twice."""
    tree: dict = {}
    for gram in grams:
        node = tree
        for c in gram + " ":
            node = node.setdefault(c, {})

    def pattern(node: dict) -> str:
        parts = [re.escape(c) + pattern(below) for c, below in node.items()]
        return "" if not parts else parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return " " + pattern(tree)


def normalised(text: Column) -> Column:
    """Lower case, words separated by single blanks, line ends kept."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def _windows(hits: Column, n: Column, size: Column, need: Column) -> Column:
    """Windows that can match, as structs (unit, u_size, hits), from a template's hits (p, g) in a text of n bigrams."""
    many, last = F.size(hits), n - size
    close = lambda i: F.get(hits, i + need - 1)["p"] < F.get(hits, i)["p"] + size
    inside = F.filter(F.sequence(F.lit(0), many - need), lambda i: (F.get(hits, i)["p"] <= last) & close(i))
    window = lambda start, some: F.struct(
        (-start - 1).alias("unit"), size.alias("u_size"), F.filter(some, lambda h: (h["p"] >= start) & (h["p"] < start + size)).alias("h")
    )
    end = F.slice(hits, F.greatest(many - size + 1, F.lit(1)), size)
    late = (F.get(hits, many - 1)["p"] > last) & (F.get(hits, many - need)["p"] >= last) & ~F.exists(end, lambda h: h["p"] == last)
    made = F.concat(
        F.transform(inside, lambda i: window(F.get(hits, i)["p"], F.slice(hits, i + 1, size))),
        F.when(late, F.array(window(last, end))).otherwise(F.array()),
    )
    return F.when(many >= need, made).otherwise(F.array())


def scan(df: DataFrame, key: str, text: str, templates: Iterable[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``df`` and matching template: key, license, dice, unit, n_units (matching units)."""
    spark = df.sparkSession
    templates = tuple(templates)
    counts = [(name, bigrams(t)) for name, t in templates]
    sizes = sorted({sum(c.values()) for _, c in counts})
    fitting = {size: bounds(size, threshold) for size in sizes}
    numbers = {g: k for k, g in enumerate(sorted({g for _, c in counts for g in c}))}
    need = {size: max(1, math.ceil(size * Fraction(str(threshold)))) for size in sizes}
    grams = [(name, size, *fitting[size], need[size], g, numbers[g], n) for name, c in counts for size in [sum(c.values())] for g, n in c.items()]
    table_ = F.broadcast(spark.createDataFrame(grams, "license string, t_size int, low int, high int, need int, gram string, g int, t_count int"))

    found = df.select(F.col(key).alias("_key"), normalised(F.col(text)).alias("_norm"))
    flat = F.concat(F.lit(" "), F.translate("_norm", "\n", " "), F.lit(" "))
    flat = F.regexp_replace(flat, " {2,}", " ")
    holds = F.col("_flat").rlike(any_of(anchors(templates, threshold)))  # one pattern: the planner copies _flat for each use
    found = found.withColumn("_flat", flat).where(holds).withColumn("_row", F.monotonically_increasing_id())
    lines = F.split("_norm", "\n")
    whole = F.when(F.size("_lines") > 1, F.trim("_flat")).otherwise(F.lit(""))
    fits = F.lit(False)
    for low, high in fitting.values():
        fits = fits | F.col("u_size").between(low, high)
    units = (
        found.withColumn("_lines", lines)
        .select("_key", "_row", F.posexplode(F.concat(F.array(F.trim("_flat"), whole), F.col("_lines"))).alias("place", "_text"))
        .select("_key", "_row", (F.col("place") - 1).alias("unit"), F.trim("_text").alias("_text"))  # -1: the text that windows are cut from
        .withColumn("u_size", F.length("_text") - F.length(F.translate("_text", " ", "")))
        .where((F.col("u_size") > 0) & (fits | ((F.col("unit") < 0) & (F.col("u_size") >= sizes[0]))))
        .withColumn("_w", F.split("_text", " "))
    )
    pairs = F.zip_with(F.expr("slice(_w, 1, size(_w) - 1)"), F.expr("slice(_w, 2, size(_w) - 1)"), lambda a, b: F.concat(a, F.lit(" "), b))
    hits = units.select("_key", "_row", "unit", "u_size", F.posexplode(pairs).alias("p", "gram")).join(table_, "gram")
    hits = hits.where(F.when(F.col("unit") < 0, F.col("u_size") >= F.col("t_size")).otherwise(F.col("u_size").between(F.col("low"), F.col("high"))))
    # a unit is one row's, so what is gathered for it is no longer than that row's text
    by_unit = hits.groupBy("_key", "_row", "unit", "license", "u_size", "t_size", "need").agg(F.sort_array(F.collect_list(F.struct("p", "g", "t_count"))).alias("h"))
    itself = F.array(F.struct("unit", "u_size", "h"))
    cut = F.when(F.col("unit") < 0, _windows(F.col("h"), F.col("u_size"), F.col("t_size"), F.col("need"))).otherwise(itself)
    scored = by_unit.select("_key", "_row", "license", "t_size", F.explode(cut).alias("u")).select("_key", "_row", "license", "t_size", "u.*")
    scored = scored.where(2.0 * F.size("h") / (F.col("u_size") + F.col("t_size")) >= threshold)
    shared = (
        scored.select("_key", "_row", "unit", "license", "u_size", "t_size", F.explode("h").alias("x"))
        .groupBy("_key", "_row", "unit", "license", "u_size", "t_size", "x.g", "x.t_count")
        .agg(F.count(F.lit(1)).alias("u_count"))
        .groupBy("_key", "_row", "unit", "license", "u_size", "t_size")
        .agg(F.sum(F.least("u_count", F.col("t_count").cast("long"))).alias("shared"))
    )
    matches = shared.withColumn("dice", 2.0 * F.col("shared") / (F.col("u_size") + F.col("t_size"))).where(F.col("dice") >= threshold)
    best = F.min_by("unit", F.struct(-F.col("dice"), F.col("unit") < 0, F.abs("unit")))
    return (
        matches.groupBy("_key", "_row", "license")
        .agg(F.max("dice").alias("dice"), best.alias("unit"), F.count(F.lit(1)).alias("n_units"))
        .select(F.col("_key").alias(key), "license", "dice", "unit", "n_units")
    )


def op4(spark, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return scan(docs, "doc_id", "text")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = f"""
WITH templates(license, body) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in TEMPLATES)}),
t_words AS (SELECT license, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM templates),
t_grams AS (SELECT license, len(w) - 1 AS t_size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t_words),
t_counts AS (SELECT license, t_size, gram, count(*) AS t_count FROM t_grams GROUP BY ALL),
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS body FROM lines
  UNION ALL SELECT doc_id, 0, text FROM lines WHERE len(l) > 1),
u_words AS (SELECT doc_id, unit, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM units),
u_grams AS (SELECT doc_id, unit, len(w) - 1 AS u_size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM u_words WHERE len(w) BETWEEN 2 AND 1000),
u_counts AS (SELECT doc_id, unit, u_size, gram, count(*) AS u_count FROM u_grams GROUP BY ALL),
flat AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
f_grams AS (SELECT doc_id, len(w) - 1 AS n, unnest(range(1, len(w))) AS p, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM flat WHERE len(w) > 1),
hits AS (SELECT doc_id, license, t_size, t_count, gram, p, n FROM f_grams JOIN t_counts USING (gram) WHERE n >= t_size),
starts AS (SELECT DISTINCT doc_id, license, least(p, n - t_size + 1) AS s FROM hits),
w_counts AS (
  SELECT doc_id, -s AS unit, license, t_size, t_count, gram, count(*) AS u_count
  FROM starts JOIN hits USING (doc_id, license) WHERE p BETWEEN s AND s + t_size - 1 GROUP BY ALL),
shared AS (
  SELECT doc_id, unit, license, u_size, t_size, sum(least(u_count, t_count)) AS shared
  FROM u_counts JOIN t_counts USING (gram) GROUP BY ALL
  UNION ALL SELECT doc_id, unit, license, t_size, t_size, sum(least(u_count, t_count)) FROM w_counts GROUP BY ALL),
matches AS (SELECT *, 2.0::DOUBLE * shared::DOUBLE / (u_size + t_size)::DOUBLE AS dice FROM shared WHERE 2.0::DOUBLE * shared::DOUBLE / (u_size + t_size)::DOUBLE >= {THRESHOLD}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, unit < 0, abs(unit)) AS k, count(*) OVER (PARTITION BY doc_id, license) AS n_units FROM matches)
SELECT doc_id, license, dice, CAST(unit AS INT) AS unit, n_units FROM ranked WHERE k = 1
"""
