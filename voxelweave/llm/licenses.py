"""Licence scans: TF-IDF cosine to templates, then inheritance along directories.

Every line of a file, every block of lines between blank ones (a header) and, for
files named like a licence file, the whole text is a sparse TF-IDF vector,
compared with the templates: notices, headers, titles and whole short licences, and
the line with an SPDX identifier. Document frequencies are those of all lines. A
file's own licence is that of the template with the highest cosine above the
threshold. A file without one takes that of the licence file in its nearest
ancestor directory, found by joining directories with the ancestors of each directory.

Words outside all templates weigh as much as a word no line has. A unit without a
telling word scores zero.

Defined cases: a null text counts as empty, a null path as a file of its own
without directories; of equal scores the first template by name wins; of several
licence files in a directory the highest score, then the first path; repeated
rows each give a row; all columns but the text stay, except that the result
columns replace columns of their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.session import materialize

# Names, notices, headers and short texts of public licences. What follows # tells texts of one licence apart.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software
Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}
for more details. You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "Apache-2.0#header": _APACHE,
    "Apache-2.0#title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "BSD-2-Clause": "Redistributions of source code must retain the above copyright notice, BSD 2-Clause License.", "BSD-2-Clause#text": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "BSD-3-Clause#text": f"{_BSD} {_BSD_THIRD} {_BSD_END}",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "GPL-2.0#header": _GNU.format("program", "General Public License", "2"), "GPL-2.0#title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#header": _GNU.format("program", "General Public License", "3"), "GPL-3.0#title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0#header": _GNU.format("program", "Affero General Public License", "3"),
    "AGPL-3.0#title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "ISC#grant": _ISC, "ISC#text": f"ISC License {_ISC} {_ISC_END}",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1#header": _GNU.format("library", "Lesser General Public License", "2.1"),
    "LGPL-2.1#title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0#title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT": "Released under the MIT License.", "MIT#text": f"MIT License {_MIT}",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.", "MPL-2.0#header": _MPL,
    "MPL-2.0#title": "Mozilla Public License Version 2.0",
    "Unlicense#text": _UNLICENSE, "Zlib#text": _ZLIB,
} | {f"{name}#spdx": f"SPDX-License-Identifier: {name}" for name in (
    "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-NC-4.0", "CC-BY-4.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0",
    "GPL-3.0-only", "GPL-3.0-or-later", "AGPL-3.0-only", "ISC", "LGPL-2.1-only", "MIT", "MPL-2.0", "Unlicense", "Zlib")}
# A unit without one of these words is not compared. mit is a German word, and the other words of the texts are common in prose.
TELLING = ("redistributions", "redistribution", "spdx-license-identifier", "unencumbered", "merchantability", "licensed", "licenses", "license",
           "permission", "warranties", "warranty", "mozilla", "apache", "by-nc", "gnu")
WORD = r"[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*"
FILE_NAMES = r"(?i)^(?:licen[sc]e|copying|notice)(?:[.-].*)?$"
THRESHOLD = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return [w.lower() for w in re.findall(WORD, text)]


VOCABULARY = sorted({w for t in TEMPLATES.values() for w in words_of(t)})
TELLING_PATTERN = r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(TELLING) + r")(?![A-Za-z0-9])"
PARAGRAPH = r"\n[\x20\t\r]*\n"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def frequencies(lines: DataFrame) -> tuple[int, dict[str, int]]:
    """All lines, and for each word of the templates (a fixed list) the lines that have it."""
    held = F.array_intersect(F.array_distinct(words(F.col("line"))), F.lit(VOCABULARY))
    got = lines.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    found = {r["w"]: r["n"] for r in got}  # a row for each word of the list
    return found.get("", 0), {w: found.get(w, 0) for w in VOCABULARY}


def _lookup(numbers: dict[str, float], word: Column) -> Column:
    """A fixed table of words as an expression; 0 for other words."""
    table = F.map_from_arrays(F.lit(list(numbers)), F.lit([float(x) for x in numbers.values()]))
    return F.coalesce(F.try_element_at(table, word), F.lit(0.0))


def own_scores(units: DataFrame, total: int, df: dict[str, int]) -> DataFrame:
    """The best template of each file: (uid, score, order) from (uid, unit, text)."""
    idf = {w: math.log((1 + total) / (1 + df[w])) for w in VOCABULARY}
    outside = math.log(1 + total)
    counts = units.select("uid", "unit", F.explode(words(F.col("text"))).alias("word")).groupBy("uid", "unit", "word").agg(
        F.count("*").cast("double").alias("tf"))
    known = F.array_contains(F.lit(VOCABULARY), F.col("word"))
    counts = counts.withColumn("w", F.col("tf") * F.when(known, _lookup(idf, F.col("word"))).otherwise(outside))
    dots = []
    for i, name in enumerate(sorted(TEMPLATES)):
        tf = {w: 0 for w in words_of(TEMPLATES[name])}
        for w in words_of(TEMPLATES[name]):
            tf[w] += 1
        size = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items())) or 1.0
        dots.append(F.sum(F.col("w") * _lookup({w: n * idf[w] / size for w, n in tf.items()}, F.col("word"))).alias(f"d{i}"))
    lines = counts.groupBy("uid", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    score = lambda i: F.when(F.col("norm") > 0, F.round(F.col(f"d{i}") / F.col("norm"), 6)).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(score(i).alias("score"), F.lit(-i).alias("order")) for i in range(len(dots))]))
    return lines.groupBy("uid").agg(F.max(best).alias("top")).select("uid", "top.score", "top.order")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All files, without the text, with own_license, own_score, license, found (own or inherited) and from_dir."""
    made = ("own_license", "own_score", "license", "found", "from_dir")
    others = [c for c in files.columns if c not in (*made, text_col)]
    path, text = F.col(f"`{path_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    is_file = F.coalesce(F.regexp_extract(path, r"[^/]*$", 0).rlike(FILE_NAMES), F.lit(False))
    whole = F.when(is_file & text.contains("\n"), F.array(text)).otherwise(F.array().cast("array<string>"))
    blocks = F.filter(F.split(text, PARAGRAPH), lambda u: u.contains("\n"))
    units = F.filter(F.concat(F.split(text, "\n"), blocks, whole), lambda u: u.rlike(TELLING_PATTERN))
    held = materialize(files.select(
        F.monotonically_increasing_id().alias("__uid"), *[F.col(f"`{c}`") for c in others], is_file.alias("__file"),
        F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).alias("__dir"), units.alias("__units"),
    ), "files")
    total, df = frequencies(files.select(F.explode(F.split(text, "\n")).alias("line")))
    lines = held.select(F.col("__uid").alias("uid"), F.posexplode("__units").alias("unit", "text"))
    scores = own_scores(lines, total, df).withColumnRenamed("uid", "__uid")
    scanned = materialize(held.drop("__units").join(scores, "__uid", "left").select(
        *[F.col(f"`{c}`") for c in others], "__file", "__dir",
        F.when(F.col("score") >= threshold, F.element_at(F.lit([n.split("#")[0] for n in sorted(TEMPLATES)]), 1 - F.col("order"))).alias("own_license"),
        F.coalesce("score", F.lit(0.0)).alias("own_score"),
    ), "scanned")
    given = scanned.filter(F.col("__file") & F.col("own_license").isNotNull() & F.col("__dir").isNotNull())
    given = given.groupBy(F.col("__dir").alias("ancestor")).agg(
        F.min(F.struct((-F.col("own_score")).alias("s"), F.col(f"`{path_col}`").alias("p"), F.col("own_license").alias("l"))).alias("x"))
    folders = scanned.filter("__dir IS NOT NULL").select("__dir").distinct()
    parts = F.split("__dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("ancestor")))
    nearest = folders.select("__dir", F.explode(ups).alias("u")).select("__dir", "u.depth", "u.ancestor").join(
        given.select("ancestor", F.col("x.l").alias("license")), "ancestor")
    nearest = nearest.groupBy("__dir").agg(F.max(F.struct("depth", "ancestor", "license")).alias("n"))
    nearest = materialize(nearest.select("__dir", F.col("n.ancestor").alias("from_dir"), F.col("n.license").alias("inherited")), "nearest")
    own = F.col("own_license").isNotNull()
    return scanned.join(nearest, "__dir", "left").select(
        *[F.col(f"`{c}`") for c in others], "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"),
        F.when(own, "own").when(F.col("inherited").isNotNull(), "inherited").alias("found"), F.when(~own, F.col("from_dir")).alias("from_dir"),
    )
