"""Licence detection by sparse TF-IDF cosine, inherited from the nearest ancestor directory (DataFrame functions only).

A text is compared with the templates in units: the whole text of a licence
file (base name LICENSE, LICENCE, COPYING or NOTICE), the header block of any
file (its leading comment), every paragraph of several lines, and every line.
Lines are compared with ``templates``, larger units with ``bodies`` too, without
function words. A file's own licence is the template of the greatest cosine of
at least ``threshold`` (ties: the earlier name) in the whole text, else in the
header block, else in paragraphs and lines. Templates that differ only in
numbers need their numbers in the unit, and a name gives way to its versions
(gpl to gpl-3.0). A directory's licence is that of the licence files in it. A
file without a licence of its own inherits that of the nearest directory above
it that has one; distinct directories are resolved, not files.

Units are scored inside their row, so no text and no line is shuffled. A unit
is scored if it has a word without which no template can reach the threshold;
its length is summed over the runs of its sorted words. Templates are part of
the plan, some hundreds at most; the long licences (GPL, LGPL, AGPL, Apache,
MPL, CC) are known by their title and their notice, not by their full text.
Defined results: null and empty texts and null paths have no licence of their
own; a null path inherits nothing; equal rows get equal results; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

# Header lines and titles of common licences.
TEMPLATES = {
    "agpl": "GNU Affero General Public License",
    "agpl-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License, version 3"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    "bsd-2-clause": "BSD 2-Clause License",
    "bsd-3-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD 3-Clause License"),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "gpl": "GNU General Public License",
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    "isc": ("Released under the ISC License", "ISC License"),
    "lgpl": ("GNU Lesser General Public License", "GNU Library General Public License"),
    "lgpl-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 2.1"),
    "lgpl-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 3"),
    "mit": ("Released under the MIT License", "MIT License", "The MIT License (MIT)"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
}


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


_NO_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
_COPYRIGHT_HOLDER = "Copyright (c) year, holder. "
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
_APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'

# Bodies, notices and titles of several lines.
BODIES = {
    "apache-2.0": (_APACHE, _APACHE + _APACHE_END, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "bsd-2-clause": _COPYRIGHT_HOLDER + _BSD + _BSD_END,
    "bsd-3-clause": _COPYRIGHT_HOLDER + _BSD + _BSD_3 + _BSD_END,
    "isc": (_ISC, _COPYRIGHT_HOLDER + _ISC + _ISC_END),
    "mit": (_MIT, _COPYRIGHT_HOLDER + _MIT + _MIT_END),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "agpl-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
}
for _key, _name, _version in (("agpl-3.0", "Affero General Public License", "3"), ("gpl-2.0", "General Public License", "2"), ("gpl-3.0", "General Public License", "3"), ("lgpl-2.1", "Lesser General Public License", "2.1"), ("lgpl-3.0", "Lesser General Public License", "3")):
    BODIES[_key] = (BODIES[_key], _gnu(_name, _version), _gnu(_name, _version) + _NO_WARRANTY.format(_name))
#: Function words, which larger units are compared without.
STOP = ("a", "all", "an", "and", "any", "are", "as", "at", "be", "but", "by", "for", "from", "in", "is", "it", "no", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you")
_COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--)"
THRESHOLD = 0.7
LICENSE_FILE = "^(LICEN[SC]E|COPYING|NOTICE)"


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def telling_words(weights: dict[str, float], threshold: float) -> set[str]:
    """Words of which a line must have one: all others together cannot reach ``threshold`` (Cauchy-Schwarz)."""
    left, out = threshold**2 - 1e-9, set(weights)
    for word in sorted(weights, key=lambda w: (weights[w], len(w), w)):
        left -= weights[word] ** 2
        if left <= 0:
            break
        out.discard(word)
    return out


def _lookup(values: dict[str, float], word: Column, default: float) -> Column:
    pairs = [F.lit(x) for item in sorted(values.items()) for x in item]
    return F.coalesce(F.create_map(*pairs)[word], F.lit(default))


def _length(words: Column, idf: dict[str, float], rare: float) -> Column:
    """Euclidean length of the TF-IDF vector of ``words``, from the runs of equal words after sorting."""
    start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def closed(state: Column) -> Column:
        x = state["run"] * _lookup(idf, state["word"], rare)
        return state["total"] + x * x

    def step(state: Column, word: Column) -> Column:
        same = state["word"] == word
        return F.struct(word.alias("word"), F.when(same, state["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"), F.when(same, state["total"]).otherwise(closed(state)).alias("total"))

    return F.aggregate(F.array_sort(words), start, step, lambda state: F.sqrt(closed(state)))


def _pairs(templates: dict[str, str | tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(name, t) for name, some in sorted(templates.items()) for t in ([some] if isinstance(some, str) else some)]


def _reached(units: Column, pairs: list[tuple[str, str]], threshold: float, stop: tuple[str, ...] = ()) -> Column:
    """Structs (rank, score, name) of templates that ``units(rank, s)`` reach, scores negated."""
    tf = [Counter(w for w in _words(t) if w not in stop) for _, t in pairs]
    df = Counter(w for c in tf for w in c)
    idf = {w: math.log((1 + len(tf)) / (1 + n)) + 1 for w, n in df.items()}
    rare = math.log(1 + len(tf)) + 1  # of words in no template
    norm = [math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())) for c in tf]
    weights = [(name, {w: n * idf[w] / x for w, n in c.items()}) for (name, _), c, x in zip(pairs, tf, norm, strict=True) if c]
    bare = {}
    for name, w in weights:
        bare.setdefault(frozenset(x for x in w if not x.isdigit()), set()).add(name)
    telling = set().union(*(telling_words(w, threshold) for _, w in weights))
    # cos >= t needs the hits' squares to be at least t^2 / (1 - t^2) of the others'; idf of a hit is at most rare
    need = threshold**2 / (1 - threshold**2)
    some = F.filter(units, lambda u: u["s"].rlike(r"(?<![a-z0-9])(?:" + "|".join(sorted(telling)) + r")(?![a-z0-9])"))
    split = F.transform(some, lambda u: F.struct(u["rank"].alias("rank"), F.filter(F.split(u["s"], "[^a-z0-9]+"), lambda w: ~w.isin("", *stop)).alias("words")))
    both = F.transform(split, lambda u: F.struct(u["rank"].alias("rank"), u["words"].alias("words"), F.filter(u["words"], lambda x: x.isin(*sorted(idf))).alias("hits")))
    near = F.filter(both, lambda b: F.size(b["hits"]) * F.size(b["hits"]) >= need * (F.size(b["words"]) - F.size(b["hits"])))
    sized = F.transform(near, lambda b: F.struct(b["rank"].alias("rank"), b["hits"].alias("hits"), _length(b["words"], idf, rare).alias("length")))

    def score(b: Column, name: str, weight: dict[str, float]) -> Column:
        gain = {w: idf[w] * x for w, x in weight.items()}
        dot = F.aggregate(b["hits"], F.lit(0.0), lambda total, w: total + _lookup(gain, w, 0.0))
        # a title needs all of its words, and a template the numbers that tell it from another
        numbers = {w for w in weight if w.isdigit()} if len(bare[frozenset(x for x in weight if not x.isdigit())]) > 1 else set()
        must = sorted(weight) if len(weight) <= 3 else sorted(numbers)
        met = F.size(F.array_except(F.array(*map(F.lit, must)), b["hits"])) == 0 if must else F.lit(True)
        return F.when(met, F.struct(b["rank"].alias("rank"), (-F.round(dot / b["length"], 9)).alias("score"), F.lit(name).alias("name")))

    scores = F.flatten(F.transform(sized, lambda b: F.array(*[score(b, name, w) for name, w in weights])))
    return F.filter(scores, lambda s: s["score"] <= -threshold)


def _units(text: Column, whole: Column) -> Column:
    """Structs (rank, s): the whole text if ``whole`` (0), the header block (1), paragraphs of several lines (2)."""
    lines = F.split(text, "\n")
    end = F.array_position(F.transform(lines, lambda s: ~s.rlike(_COMMENT)), F.lit(True))
    leading = F.array_join(F.when(end == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))), "\n")
    bare = F.ltrim(text)
    header = F.when(bare.startswith("/*"), F.substring_index(bare, "*/", 1)).when(bare.startswith("<!--"), F.substring_index(bare, "-->", 1)).otherwise(leading)
    unit = lambda rank, s: F.struct(F.lit(rank).alias("rank"), s.alias("s"))
    blocks = F.filter(F.split(text, r"\n(?:[^a-z0-9\n]*+\n)++"), lambda s: s.contains("\n"))
    some = F.concat(F.array(unit(0, F.when(whole, text)), unit(1, header)), F.transform(blocks, lambda s: unit(2, s)))
    return F.filter(some, lambda u: u["s"].isNotNull())


def own_license(text: Column, templates: dict[str, str | tuple[str, ...]], threshold: float, bodies: dict[str, str | tuple[str, ...]] | None = None, whole: Column | None = None) -> Column:
    """(rank, score, name) of the best template of ``text`` as a struct, its score negated; null without one."""
    low = F.lower(text)
    lines = F.transform(F.split(low, "\n"), lambda s: F.struct(F.lit(2).alias("rank"), s.alias("s")))
    found = _reached(lines, _pairs(templates), threshold)
    units = _units(low, F.lit(False) if whole is None else whole)
    found = F.concat(found, _reached(units, _pairs(templates) + _pairs(bodies or {}), threshold, STOP))
    # bound as a variable, so that it is found once; only versions in a unit of the same or a higher rank displace a name
    kept = F.transform(F.array(found), lambda f: F.filter(f, lambda s: ~F.exists(f, lambda t: (t["rank"] <= s["rank"]) & t["name"].startswith(F.concat(s["name"], F.lit("-"))))))
    return F.array_min(F.flatten(kept))


def scan_licenses(files: DataFrame, templates: dict[str, str | tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, bodies: dict[str, str | tuple[str, ...]] = BODIES) -> DataFrame:
    """(doc_id, path, own_license, own_score, license, inherited_from) for every row of ``files(doc_id, path, text)``."""
    base = F.element_at(F.split(F.col("path").cast("string"), "/"), -1)
    named_so = F.coalesce(base.rlike(LICENSE_FILE), F.lit(False))
    best = own_license(F.col("text").cast("string"), templates, threshold, bodies, named_so)
    rows = durable(files.select("doc_id", F.col("path").cast("string").alias("path"), best.alias("best")))
    rows = rows.select("doc_id", "path", F.col("best.name").alias("own_license"), (-F.col("best.score")).alias("own_score"))
    rows = rows.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")))
    base = F.element_at(F.split("path", "/"), -1)
    at = rows.where(base.rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    named = durable(at.groupBy(F.col("dir").alias("up")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license")).alias("b")).select("up", F.col("b.own_license").alias("dir_license")))
    # ancestors of each distinct directory, nearest first by length
    parts = F.split("dir", "/")
    ups = rows.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up"))
    nearest = ups.join(named, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "dir_license")).alias("m")).select("dir", F.col("m.up").alias("up"), F.col("m.dir_license").alias("dir_license"))
    out = rows.join(nearest, "dir", "left")
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("up")).alias("inherited_from"))
