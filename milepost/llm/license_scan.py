"""License scan: which license texts do documents hold, and where.

Templates are grouped into classes by their number of five-word shingles, and
a document is read through overlapping windows of each class's size, so that
every contiguous copy of a template lies whole in some window.  Windows and
templates are summarised by MinHash and meet in bands of one row; the number of
bands follows from the least similarity that a match of the class can have, so
that a matching window is missed with a probability below ``miss``.  What meets
is verified exactly: a template matches where a window holds at least
``percent`` of its distinct shingles.

One scan serves all classes: a document is split and its shingles are hashed
once.  Steps that lose nothing come first.  Only texts with a key word are
split: the key words are chosen so that more than the tolerated part of every
template's shingles contain one.  Only documents that hold the least number of
a class's shingles go on to its windows, and only windows over such a shingle
are summarised.

All of it is DataFrame functions; the templates are a small fixed table.

Defined results: a null or empty text holds nothing; texts of any length are
read whole; rows with a null id are scanned; rows that repeat an id are scanned
each and reported once; an empty table gives no rows; other columns are
ignored.  A template shorter than five words raises ValueError.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5

#: Well-known license notices, by their usual short names.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "ISC-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "MIT-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "BSD-conditions": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-3-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."
    ),
    "ISC-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-statement": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."
    ),
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _shingles(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[k : k + WORDS]) for k in range(len(words) - WORDS + 1)))


def key_words(sets: dict[str, list[str]], percent: int) -> list[str]:
    """Few words such that more than 100 - percent of every template's shingles
    contain one: each time the word that does most for what is still missing."""
    missing = {name: len(s) * (100 - percent) // 100 + 1 for name, s in sets.items()}
    left = {name: set(s) for name, s in sets.items()}
    chosen: list[str] = []
    while any(n > 0 for n in missing.values()):
        gain: dict[str, float] = {}
        for name, s in left.items():
            if missing[name] > 0:
                hits: dict[str, int] = {}
                for x in s:
                    for w in set(x.split()):
                        hits[w] = hits.get(w, 0) + 1
                for w, n in hits.items():
                    # a short word is found in many texts
                    gain[w] = gain.get(w, 0.0) + min(n, missing[name]) / missing[name] * (1.0 if len(w) > 5 else 0.1)
        best = max(gain, key=lambda w: (gain[w], w))
        chosen.append(best)
        for name, s in left.items():
            found = {x for x in s if best in x.split()}
            missing[name] -= len(found)
            left[name] = s - found
    return chosen


def template_classes(templates: dict[str, str], percent: int = 75, miss: float = 1e-4) -> list[dict]:
    """Per class: window size, stride, bands, least shared shingles, templates."""
    sets = {}
    for name, text in templates.items():
        sets[name] = _shingles(template_words(text))
        if not sets[name]:
            raise ValueError(f"template {name} has fewer than {WORDS} words")
    classes: dict[int, list[str]] = {}
    for name, s in sets.items():
        classes.setdefault(max(0, math.ceil(math.log2(len(s)))), []).append(name)
    out = []
    for c, names in sorted(classes.items()):
        most, fewest = max(len(sets[n]) for n in names), min(len(sets[n]) for n in names)
        stride = max(1, most // 4)
        size = most + stride - 1
        held = math.ceil(fewest * percent / 100)
        likeness = held / (size + fewest - held)
        bands = 1 if likeness >= 1 else math.ceil(math.log(miss) / math.log(1 - likeness))
        out.append({"class": c, "size": size, "stride": stride, "bands": bands, "held": held, "templates": [{"name": n, "shingles": sets[n]} for n in names]})
    return out


def _hash(words: Column) -> Column:
    """A shingle's hash from the array of its words."""
    return F.xxhash64(*[F.get(words, F.lit(k)) for k in range(WORDS)])


def _least(hashes: Column, points: Column) -> Column:
    """MinHash values: under each point, the hash next to it.

    Flipping the bits of a point permutes the hashes, so the least flipped one
    is the least under a permutation of the point's own.
    """
    return F.transform(points, lambda p: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(p))))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, miss: float = 1e-4) -> DataFrame:
    """One row per document and template found: id, license, containment (the
    best window's), first_word (that window's place, in words) and n_windows."""
    spark = docs.sparkSession
    classes = template_classes(templates or TEMPLATES, percent, miss)
    keys = key_words({t["name"]: t["shingles"] for c in classes for t in c["templates"]}, percent)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    rows = rows.where(reduce(lambda a, b: a | b, [F.contains("text", F.lit(k)) for k in keys]))
    words = F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0))
    # explode keeps the arrays from being made anew inside every lambda that reads them
    rows = rows.select("id", "row", F.explode(F.array(words)).alias("w")).where(F.size("w") >= WORDS)
    rows = rows.select("id", "row", F.explode(F.array(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - WORDS + 1, F.lit(1))), lambda i: _hash(F.slice("w", i, F.lit(WORDS)))))).alias("g"))

    # the fixed templates, hashed: a few thousand numbers
    shape = "array<struct<class:int,name:string,shingles:array<string>>>"
    listed = [{"class": c["class"], **t} for c in classes for t in c["templates"]]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(listed)), shape)))
    hashed = table.select("class", "name", F.transform("shingles", lambda x: _hash(F.split(x, " "))).alias("t")).collect()
    point = random.Random(5)
    points = [point.getrandbits(64) - (1 << 63) for _ in range(max(c["bands"] for c in classes))]
    kinds = [
        {k: c[k] for k in ("class", "size", "stride", "held")} | {"points": points[: c["bands"]], "any": sorted({h for r in hashed if r["class"] == c["class"] for h in r["t"]})}
        for c in classes
    ]
    # as literals, so that no row parses them
    longs = lambda values: f"array({', '.join(f'{v}L' for v in values)})"
    written = lambda v: longs(v) if isinstance(v, list) else str(v)
    each = F.expr(f"array({', '.join('named_struct(' + ', '.join(f"'{n}', {written(v)}" for n, v in k.items()) + ')' for k in kinds)})")
    every = F.expr(longs(sorted({h for k in kinds for h in k["any"]})))
    rows = rows.where(F.arrays_overlap("g", every)).select("id", "row", "g", F.explode(each).alias("c"))
    rows = rows.withColumn("met", F.array_intersect("g", "c.any")).where(F.size("met") >= F.col("c.held"))
    # windows over the places of the class's shingles
    places = F.filter(F.transform("g", lambda h, i: F.when(F.array_contains("met", h), i)), lambda i: i.isNotNull())
    stride, size = F.col("c.stride"), F.col("c.size")
    first = lambda i: F.greatest(F.floor((i - size) / stride) + 1, F.lit(0).cast("long"))
    over = F.flatten(F.transform(places, lambda i: F.sequence(first(i), F.floor(i / stride))))
    at = rows.select("id", "row", "g", "c", F.explode(F.array_distinct(over)).alias("k"))
    start = (F.col("k") * stride).cast("int")
    windows = at.select("id", "row", "c.class", "c.points", start.alias("start"), F.array_distinct(F.slice("g", start + 1, size)).alias("w"))
    met = windows.select("id", "row", "class", "start", "w", F.posexplode(_least(F.col("w"), F.col("points"))).alias("band", "value"))
    bands = spark.createDataFrame(hashed, "class int, name string, t array<long>").join(
        spark.range(1).select(F.inline(each)).select("class", "points"), "class"
    )
    bands = bands.select("class", "name", "t", F.posexplode(_least(F.col("t"), F.col("points"))).alias("band", "value"))
    met = met.join(F.broadcast(bands), ["class", "band", "value"])
    held = F.size(F.array_intersect("w", "t")) / F.size("t")
    found = met.select("id", "row", "start", F.col("name").alias("license"), held.alias("containment")).where(F.col("containment") * 100 >= percent)
    best = F.max(F.struct("containment", (-F.col("start")).alias("s")))
    return (
        found.groupBy("id", "license")
        .agg(best.alias("b"), F.count_distinct("row", "start").alias("n_windows"))
        .select(F.col("id").alias(id_col), "license", F.col("b.containment").alias("containment"), (-F.col("b.s")).alias("first_word"), "n_windows")
    )
