"""License scans in DataFrame operations: MinHash bands over overlapping word windows find templates, exact shingle
containment verifies them.

A text's words (letters and digits, lower case) make 5-word shingles, each one 64-bit hash. Windows of eight shingles begin at
every fourth; each has twelve minima of (hash xor a fixed mask), two to a band. A window that equals one of a template's
shares all six bands with it; windows of similarity s share one with probability 1 - (1 - s^2)^6: 0.998 at 0.8, 0.9996 at 0.85.
Templates are indexed at every offset, so an unaltered window is found wherever it lies. A template
of fewer than fifteen words may hold no whole window that begins at a text's fourth place; it is indexed by single shingles,
of which a text has every one, so any unaltered shingle finds it.

Each hit names a template and where it would begin; the shingles of that stretch of the text (a quarter longer at both ends)
are then compared with the template's, exactly. Matches have at least `least` of the template's distinct shingles.

The templates are a parameter; their index is broadcast, and its size is that of the templates, not of the documents (at most
10 keys a template word; `index` refuses more than MOST_KEYS).

Cases: null and empty texts, and those of fewer than five words, match nothing. Results have a row for each distinct
(doc_id, text) and template that match; repeated rows make one. Equal containments tell the first place. Other columns are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, STRIDE, WINDOW, BANDS, ROWS = 5, 4, 8, 6, 2
LEAST, MOST_KEYS = 0.8, 1_000_000
SPLIT = r"[^\p{L}\p{N}]+"
#: Masks of the twelve minima: multiples of an odd 64-bit constant, as signed longs.
MASKS = [((i * 0x9E3779B97F4A7C15 + 2**63) % 2**64) - 2**63 for i in range(1, BANDS * ROWS + 1)]

# Notices of public licences, by name.
TEMPLATES = {
    "Apache-2.0 short": "Licensed under the Apache License, Version 2.0.",
    "MIT short": "Released under the MIT License.",
    "CC-BY-NC-4.0 short": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 short": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def shingles(all_words: Column, start: Column, end: Column) -> Column:
    """Hashes of the shingles that begin at start to end - 1, by a higher-order function: for stretches, not whole texts."""
    at = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.xxhash64(F.get(all_words, i + j)) for j in range(SHINGLE)]))


def keyed(rows: DataFrame, stride: int) -> DataFrame:
    """From rows with `words`: every window's place p with its keys, as columns band_0.. and one_0.. (null where there is none)."""
    n, long = F.col("n"), WINDOW + SHINGLE - 1
    rows = rows.withColumn("n", F.size("words"))
    # The last full window ends with the text; those that run over its end count for their single shingles alone.
    starts = F.array_union(F.sequence(F.lit(0), n - SHINGLE, F.lit(stride)), F.array(F.greatest(n - long, F.lit(0))))
    rows = rows.withColumn("p", F.explode(F.when(n >= SHINGLE, starts)))  # a filter would split texts twice
    held = [c for c in rows.columns]
    # A word past the end is empty, which no template has, so its shingles equal none.
    rows = rows.select(*held, *[F.xxhash64(F.coalesce(F.get("words", F.col("p") + j), F.lit(""))).alias(f"h{j}") for j in range(long)])
    rows = rows.select(*held, *[F.xxhash64(*[f"h{j + k}" for k in range(SHINGLE)]).alias(f"s{j}") for j in range(WINDOW)])
    # Minima of arrays, not `least`: a tenth of the generated code, which must stay small to be compiled.
    least = [F.array_min(F.array(*[F.col(f"s{j}").bitwiseXOR(F.lit(m)) for j in range(WINDOW)])).alias(f"m{i}") for i, m in enumerate(MASKS)]
    rows = rows.select(*held, *[f"s{j}" for j in range(STRIDE)], *least)
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return rows.select(*held, F.array(*bands).alias("bands"), F.array(*[f"s{j}" for j in range(STRIDE)]).alias("ones"))


def index(spark: SparkSession, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """key, template, its length and distinct shingles, and the places of the windows with that key; made from the templates once."""
    rows = spark.createDataFrame([(k, v) for k, v in templates.items()], "template string, text string").select("template", words(F.col("text")).alias("words"))
    rows = rows.withColumn("all", F.array_distinct(shingles(F.col("words"), F.lit(0), F.size("words") - SHINGLE + 1)))
    found: dict[tuple[int, str], set[int]] = defaultdict(set)
    held = {r["template"]: (r["n"], r["all"]) for r in rows.select("template", F.size("words").alias("n"), "all").collect()}
    for r in keyed(rows.select("template", "words"), 1).select("template", "p", "bands", "ones").collect():
        if held[r["template"]][0] < WINDOW + SHINGLE - 1 + STRIDE - 1:
            found[r["ones"][0], r["template"]].add(r["p"])
        elif r["p"] + WINDOW + SHINGLE - 1 <= held[r["template"]][0]:
            for key in r["bands"]:
                found[key, r["template"]].add(r["p"])
    if len(found) > MOST_KEYS:
        raise ValueError(f"the templates make {len(found)} keys, over {MOST_KEYS}: scan with fewer at a time")
    keys = [(key, t, *held[t], sorted(places)) for (key, t), places in found.items()]
    return spark.createDataFrame(keys, "key long, template string, length int, template_shingles array<long>, places array<int>")


def scan(spark: SparkSession, docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, template, containment, start (first word of the stretch) and hits (windows that found it), for all matches."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    windows = keyed(rows, STRIDE)
    # A window's own shingles have their places; its bands stand for all of it.
    keys = F.concat(F.col("bands"), F.col("ones"))
    found = windows.select("doc_id", "text_hash", "words", "n", "p", F.posexplode(keys).alias("k", "key"))
    at = F.col("p") + F.greatest(F.col("k") - BANDS, F.lit(0))
    found = found.select("doc_id", "text_hash", "words", "n", at.alias("at"), "key").join(F.broadcast(index(spark, templates)), "key")
    found = found.withColumn("place", F.explode("places"))
    slack = F.floor(F.col("length") / 4).cast("int") + 1
    begin = F.greatest(F.lit(0), F.col("at") - F.col("place") - slack)
    end = F.least(F.col("n") - SHINGLE + 1, F.col("at") - F.col("place") + F.col("length") - SHINGLE + 1 + slack)
    same = F.size(F.array_intersect("template_shingles", shingles(F.col("words"), begin, end)))
    found = found.select("doc_id", "text_hash", "template", (F.col("at") - F.col("place")).alias("start"), (same / F.size("template_shingles")).alias("containment"))
    found = found.where(F.col("containment") >= least).groupBy("doc_id", "text_hash", "template")
    best = F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best")
    return found.agg(best, F.count("*").alias("hits")).select("doc_id", "template", "best.containment", (-F.col("best.back")).alias("start"), "hits")
