"""Operator 6: license scan by the Dice coefficient over word bigrams, of normalised text against license templates.

Both sides are normalised (lower case, runs of anything but a-z and 0-9 are one space, so comment marks vanish). What is compared are units of
a text: its lines, the whole, and windows of a template's word count that may lie anywhere and run over line ends. Bigrams count as
often as they occur, so a unit of n words has n - 1 of them, and a Dice coefficient of d needs the smaller side to have at least d / (2 - d)
times the bigrams of the larger: these size bounds prune candidate templates before any bigram is made.

Each template has anchors: words that stand in more of its bigrams than a match may lack. A text or line without any anchor matches nothing
and goes no further; and windows are laid where an anchor of the text falls on its place in the template.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import stage, table

# Public license notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "proprietary": "All rights reserved.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
        "OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        'permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You '
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
        "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
}
LEAST = 0.8
#: Words of a text that are looked through at a time for windows.
CHUNK = 2048


def normal(text: Column) -> Column:
    """Lower case; runs of anything but a-z, 0-9 and line ends are one space."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " ")


def words_of(text: str) -> list[str]:
    """Normalised words of a template."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    """Bigrams, each numbered among its equals."""
    words = words_of(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return [f"{p} {pairs[:i].count(p) + 1}" for i, p in enumerate(pairs)]


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """Fewest and most bigrams with which a unit can reach ``least`` against n bigrams."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def lacking(n: int, least: float) -> int:
    """Most of a template's n bigrams that a unit of any admissible size can lack and still reach ``least``."""
    return n - math.ceil(least * (n + size_bounds(n, least)[0]) / 2 - 1e-4)


def anchors(text: str, least: float) -> list[tuple[str, int]]:
    """(word, place) of a template's anchors, every place: its longest words, as few of them as stand in more bigrams than a unit can lack."""
    words = words_of(text)
    most = lacking(len(words) - 1, least)
    chosen: set[str] = set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        chosen.add(word)
        if sum(a in chosen or b in chosen for a, b in zip(words, words[1:], strict=False)) > most:
            break
    return [(w, at) for at, w in enumerate(words) if w in chosen]


def _matching(units: DataFrame) -> DataFrame:
    """units (words, grams, plain_grams, lacks) with own: their bigrams, numbered. Units that lack too many of a template's distinct bigrams are
    dropped first: numbering takes time with the square of a unit's length, the first look doesn't."""
    plain = F.transform(F.slice("words", 1, F.size("words") - 1), lambda w, i: F.concat_ws(" ", w, F.element_at("words", i + 2)))
    units = units.withColumn("plain", plain).where(F.size(F.array_except("plain_grams", "plain")) <= F.col("lacks"))
    return units.withColumn("own", F.transform("plain", lambda p, i: F.concat_ws(" ", p, F.size(F.filter(F.slice("plain", 1, i + 1), lambda q: q == p)).cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per row of docs: id_col, license (of the best match; ties go to the first name; null without one), dice (0 without one),
    n_matches (templates that match).

    Units are the lines; the whole text, where there are several; and for every template the windows of its word count, cut short at the
    ends of the text, that put an anchor on its place. Null and empty texts match nothing; each repeated row gets its own
    result; templates of fewer than two words match nothing. Texts with an anchor are written once; only numbers are shuffled, and no
    more than CHUNK words and a window's margin of a text are looked through at a time.
    """
    given = {name: text for name, text in (TEMPLATES if templates is None else templates).items() if len(words_of(text)) > 1}
    spark = docs.sparkSession
    shelf, places, sizes, longest = [], [], set(), 1
    for name, text in sorted(given.items()):
        grams, n = template_bigrams(text), len(words_of(text)) - 1
        lo, hi = size_bounds(n, least)
        sizes |= set(range(max(lo, 1), hi + 1))
        longest = max(longest, n + 1)
        plain = sorted({g.rsplit(" ", 1)[0] for g in grams})
        lists = F.array(*map(F.lit, grams)).alias("grams"), F.array(*map(F.lit, plain)).alias("plain_grams")
        shelf.append(F.struct(F.lit(name).alias("name"), *lists, F.lit(lacking(n, least)).alias("lacks"), F.lit(max(lo, 1)).alias("lo"), F.lit(hi).alias("hi")))
        places += [F.struct(F.lit(w).alias("word"), F.lit(name).alias("name"), F.lit(at).alias("at"), F.lit(n + 1).alias("size")) for w, at in anchors(text, least)]
    marks = sorted({w for text in given.values() for w, _ in anchors(text, least)})
    none = lambda kind: F.array().cast(f"array<{kind}>")
    listed = F.array(*shelf) if shelf else none("struct<name:string,grams:array<string>,plain_grams:array<string>,lacks:int,lo:int,hi:int>")
    placed = F.array(*places) if places else none("struct<word:string,name:string,at:int,size:int>")
    marked = F.array(*map(F.lit, marks)) if marks else none("string")
    # One row per template and admissible size: bounded by the templates.
    shelf = spark.range(1).select(F.explode(listed).alias("t")).select("t.name", "t.grams", "t.plain_grams", "t.lacks", F.explode(F.sequence("t.lo", "t.hi")).alias("n"))
    split = lambda text: F.filter(F.split(text, " "), lambda w: w != "")
    flat = F.replace(F.col("plain"), F.lit("\n"), F.lit(" "))
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), normal(F.coalesce(F.col(text_col), F.lit(""))).alias("plain"))
    # Written once, so that row numbers stand whatever task is run again; only texts with an anchor are kept.
    df = stage(df.withColumn("plain", F.when(F.arrays_overlap(F.split(flat, " "), marked), F.col("plain"))), "license-texts")
    texts = df.where("plain IS NOT NULL")
    lines = F.split("plain", "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(flat))).otherwise(lines)
    fits = lambda u: (F.size(u) - 1).isin(sorted(sizes)) & F.arrays_overlap(u, marked)
    by_line = texts.select("row", F.explode(F.filter(F.transform(units, split), fits)).alias("words"))
    by_line = by_line.withColumn("n", F.size("words") - 1).join(F.broadcast(shelf), "n")
    # Each chunk with the words of a template before and after it, so that windows of its anchors lie within.
    parts = texts.select("row", split(flat).alias("words"))
    base = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(CHUNK))
    cut = F.transform(base, lambda b: F.struct(b.alias("own"), F.greatest(b - longest, F.lit(0)).alias("from"), F.slice("words", F.greatest(b - longest, F.lit(0)) + 1, CHUNK + 2 * longest).alias("words")))
    parts = parts.select("row", F.explode(cut).alias("c")).select("row", "c.*")
    ours = F.slice("words", F.col("own") - F.col("from") + 1, F.lit(CHUNK))
    hits = F.filter(F.transform(ours, lambda w, i: F.struct(w.alias("w"), (F.col("own") + i).alias("i"))), lambda h: F.array_contains(marked, h["w"]))
    start = lambda h: F.transform(F.filter(placed, lambda a: a["word"] == h["w"]), lambda a: F.struct(a["name"].alias("name"), a["size"].alias("size"), F.greatest(h["i"] - a["at"], F.lit(0)).alias("start")))
    windows = parts.select("row", "words", "from", F.explode(F.array_distinct(F.flatten(F.transform(hits, start)))).alias("w"))
    windows = windows.select("row", "w.name", F.slice("words", F.col("w.start") - F.col("from") + 1, F.col("w.size")).alias("words"))
    by_window = windows.withColumn("n", F.size("words") - 1).join(F.broadcast(shelf), ["name", "n"])
    fields = ["row", "name", "n", "words", "grams", "plain_grams", "lacks"]
    met = _matching(by_line.select(*fields).unionByName(by_window.select(*fields)))
    dice = F.round(2.0 * F.size(F.array_intersect("own", "grams")) / (F.col("n") + F.size("grams")), 6)
    best = met.groupBy("row", "name").agg(F.max(dice).alias("dice")).where(F.col("dice") >= least)
    best = best.groupBy("row").agg(F.min(F.struct((-F.col("dice")).alias("d"), "name")).alias("best"), F.count(F.lit(1)).alias("n_matches"))
    out = df.select("row", "id").join(best, "row", "left")
    return out.select(F.col("id").alias(id_col), F.col("best.name").alias("license"), F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("dice"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = sorted((k, template_bigrams(v), len(words_of(v)), anchors(v, LEAST)) for k, v in TEMPLATES.items())
    shelf = ", ".join("('{}', {}, {}, [{}])".format(k, *size_bounds(len(b), LEAST), ", ".join(f"'{g}'" for g in b)) for k, b, _, _ in known)
    marks = ", ".join(f"('{w}', '{k}', {at}, {size})" for k, _, size, a in known for w, at in a)
    return f"""
WITH shelf(name, lo, hi, grams) AS (VALUES {shelf}),
marks(word, name, place, size) AS (VALUES {marks}),
raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(CASE WHEN len(l) > 1 THEN list_append(l, array_to_string(l, ' ')) ELSE l END) AS u FROM raw),
n AS (SELECT doc_id, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
t AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(array_to_string(l, ' ')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM raw),
h AS (SELECT DISTINCT doc_id, name, size, greatest(i - place, 0) AS st FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t) AS x JOIN marks USING (word)),
f AS (SELECT doc_id, NULL AS only_name, w FROM n WHERE len(w) - 1 BETWEEN (SELECT min(lo) FROM shelf) AND (SELECT max(hi) FROM shelf)
  UNION ALL SELECT doc_id, name, w[st + 1:st + size] FROM h JOIN t USING (doc_id)),
p AS (SELECT doc_id, only_name, len(w) - 1 AS n, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM f),
g AS (SELECT doc_id, only_name, n, list_transform(range(1, n + 1), lambda i: p[i] || ' ' || len(list_filter(p[1:i], lambda x: x = p[i]))) AS own FROM p),
d AS (SELECT doc_id, name, round(2.0 * len(list_intersect(own, grams)) / (n + len(grams)), 6)::DOUBLE AS dice
  FROM g JOIN shelf ON n BETWEEN lo AND hi AND coalesce(only_name, name) = name),
b AS (SELECT doc_id, name, max(dice) AS dice FROM d WHERE dice >= {LEAST} GROUP BY doc_id, name),
m AS (SELECT doc_id, min({{'d': -dice, 'name': name}}) AS best, count(*) AS n_matches FROM b GROUP BY doc_id)
SELECT documents.doc_id, best.name AS license, coalesce(-best.d, 0.0)::DOUBLE AS dice, coalesce(n_matches, 0) AS n_matches
FROM documents LEFT JOIN m USING (doc_id)
"""


OP6_SQL = _sql()
