"""License scans in DataFrame functions alone.

A text's words form five-word shingles. Overlapping windows, sized by the length
of the templates they are to hold, are summarised by MinHash bands of one row;
a window that shares a band's value with a template retrieves it, and the share
of the template's shingles that the window holds then decides.

A band's value is the least hash of some shingle, its bearer, so a window can
meet a template in a band only if it holds that bearer. The bearers of the
templates' bands are therefore looked for first, and only windows that hold one
get a signature; no meeting is lost by it, but for equal 64-bit hashes.

Band settings: a template of L words is sought with windows of 2 * S words every
S words, S the least scale that is L or more, so some window holds an occurrence
whole. Scales grow by a quarter up to the longest template, of any length, so at
a containment of 0.8 the likeness of window and template is 1/6 or more, and
BANDS bands miss it with a chance of (5/6) ** 64 < 1e-5 at most; `missed` says
how much for a template.

Defined results: a null or empty text has no license; equal texts have equal
results; rows with one doc_id are told apart by their texts; further columns are
ignored; an empty table gives an empty result; a template without words is a
ValueError.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, pick

SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8
LEAST_SCALE, GROWTH = 5, 1.25

# Public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-3-clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def shingles(text: Column) -> Column:
    """64-bit hashes of a text's shingles, in order; of all its words if they are fewer."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    def hashed(w: Column) -> Column:
        every = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, SHINGLE)]))
        return F.slice(every, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.least(F.size(w), F.lit(1))))

    return bind(words, hashed)


def signature(window: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(window, lambda x: F.xxhash64(x, b))))


def words_of(notice: str) -> int:
    return len(re.findall(r"[^\W_]+", notice))


def scales(templates: dict[str, str]) -> list[int]:
    """Those that the templates need, of 5, 6, 8, 10, 13, ..., each a quarter more than the one before, rounded up."""
    if not all(map(words_of, templates.values())):
        raise ValueError("a template has no words")
    steps = [LEAST_SCALE]
    while steps[-1] < max(map(words_of, templates.values()), default=0):
        steps.append(math.ceil(steps[-1] * GROWTH - 1e-9))
    return sorted({next(x for x in steps if x >= words_of(t)) for t in templates.values()})


def missed(words: int, scale: int, containment: float = CONTAINMENT) -> float:
    """The chance that no band meets, for a template of so many different words in a window that holds so much of it."""
    own, window = max(1, words - SHINGLE + 1), 2 * scale - SHINGLE + 1
    held = math.ceil(containment * own - 1e-9)
    return (1 - held / (own + window - held)) ** BANDS


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, scale, its shingles: as many rows as templates."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in sorted(templates.items())])
    table = spark.range(1).select(F.inline(rows)).withColumn("own", F.array_distinct(shingles(F.col("notice"))))
    scale = F.array_min(F.filter(F.array(*[F.lit(s) for s in scales(templates)]), lambda s: s >= F.size("own") + SHINGLE - 1))
    return table.select("license", scale.alias("scale"), "own")


def bearers(own: Column) -> Column:
    """The shingle that gives each band its value."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(own, lambda x: F.struct(F.xxhash64(x, b).alias("h"), x.alias("x"))))["x"])


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_licenses, licenses (comma-joined, sorted) of each row; the plan holds BANDS numbers for each template."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").withColumn("mark", F.xxhash64("text"))
    table = template_table(spark, templates)
    known = F.array(*[F.lit(x) for x in sorted({x for r in table.select(bearers(F.col("own")).alias("b")).collect() for x in r["b"]})])

    def windows(s: Column) -> Column:
        at = lambda scale: F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(scale)), lambda i: F.struct(F.lit(scale).alias("scale"), F.slice(s, i + 1, 2 * scale - SHINGLE + 1).alias("window")))
        return F.filter(F.flatten(F.array(*[at(x) for x in scales(templates)])), lambda w: F.arrays_overlap(w["window"], known))

    found = bind(shingles(F.col("text")), lambda s: F.when(F.arrays_overlap(s, known), windows(s)))
    cut = rows.select("doc_id", "mark", F.explode(found).alias("w")).select("doc_id", "mark", "w.scale", "w.window")
    banded = cut.select("*", F.posexplode(signature(F.col("window"))).alias("band", "value"))
    bands = table.select("license", "own", F.col("scale").alias("_scale"), F.posexplode(signature(F.col("own"))).alias("_band", "_value"))
    held = F.size(F.array_intersect("window", "own")) / F.size("own")
    met = banded.join(F.broadcast(bands), (F.col("scale") == F.col("_scale")) & (F.col("band") == F.col("_band")) & (F.col("value") == F.col("_value"))).where(held >= CONTAINMENT)
    told = met.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("license")).alias("licenses")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "licenses")
    joined = rows.select("doc_id", "mark").join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    return joined.select("doc_id", F.coalesce(F.size("licenses"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("licenses", ","), F.lit("")).alias("licenses"))
