"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle
containment verifies them.

Words are runs of letters and digits, A-Z in lower case. A long template is kept as the MinHashes of all
windows of ``WINDOW`` shingles; a text is read in windows that overlap by half. With one value a band and
``BANDS`` bands a window meets a window of likeness s with probability 1 - (1 - s) ** BANDS: 0.9984 at 0.8,
and a verbatim stretch meets its own window surely. A template too short for windows is met by any of its
shingles. A template is found where the text holds ``CONTAINED`` of its shingles.

A template shorter than a shingle is one run of its own number of words, looked for anywhere in the text. Null text
counts as empty: nothing is found. Texts are read whole, whatever their length. Repeated rows get equal results.
"""

from __future__ import annotations

import json
import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import ascii_lower, shingles, whole

WIDTH = 5
WINDOW = 8
BANDS = 4
CONTAINED = 0.8
# Templates of fewer shingles than three windows are looked up by shingle.
SHORT = 3 * WINDOW
MASKS = [random.Random(seed).getrandbits(64) - (1 << 63) for seed in range(BANDS)]

# License notes and the operative paragraphs of common licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."),
    "apache-2.0-note": "Licensed under the Apache License, Version 2.0.",
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "cc-by-nc-4.0-note": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "gpl-3.0-note": "This work is licensed under the GNU General Public License, version 3.",
    "isc-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "mit-note": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    # The GPL family is cut to the words around its version, so that one version is not taken for another.
    "agpl-3.0-header": (
        "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version "
        "3 of the License"),
    "bsd-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        'WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        'PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY '
        'DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, '
        'PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) '
        'HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING '
        'NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE '
        'POSSIBILITY OF SUCH DAMAGE.'),
    "cc-by-4.0-note": "Licensed under CC BY 4.0.",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-note": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-work": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0-1.0-waiver": "has waived all copyright and related or neighboring rights to",
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "gpl-2.0-header": (
        "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License"),
    "isc-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        'INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR '
        'ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF '
        'USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF '
        'OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    "lgpl-2.1-header": (
        "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version "
        "2.1 of the License"),
    "lgpl-3.0-header": (
        "terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version "
        "3 of the License"),
    "mit-licensed-note": "Licensed under the MIT License.",
    "mit-short-note": "under the MIT License",
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        'LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO '
        'EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN '
        'AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE '
        'OR OTHER DEALINGS IN THE SOFTWARE.'),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."),
}


def plain_words(text: Column) -> Column:
    """Runs of letters and digits, A-Z in lower case."""
    return F.filter(F.split(ascii_lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(width: int, of) -> Column:
    """``of`` each run of ``width`` words; none in a text of fewer."""
    return F.when(F.size("_words") >= width, shingles("_words", width, of)).otherwise(F.array().cast("array<string>"))


def _hashed_runs(width: int, firsts: Sequence[str]) -> Column:
    """Hashes of the runs of ``width`` words that begin with one of some words: no other can be a short template."""
    w = F.col("_words")

    def run(x: Column, i: Column) -> Column:
        rest = [F.get(w, i + k) for k in range(1, width)]
        return F.when(x.isin(*firsts) & (i + width <= F.size(w)), F.xxhash64(F.concat_ws(" ", x, *rest)))

    return F.filter(F.transform(w, run), lambda h: h.isNotNull())


def _tokens(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_words", plain_words(F.col("text")))


def _strings(widths: Sequence[int]) -> Column:
    """All shingles of a text as strings, and its runs of the ``widths`` of short templates."""
    return F.array_distinct(F.concat(shingles("_words", WIDTH, lambda s: s), *[_runs(n, lambda s: s) for n in widths]))


def _window_keys(hashes: str) -> Column:
    """MinHashes of the windows of a text, that overlap by half, all bands."""
    h, half = F.col(hashes), WINDOW // 2
    count = F.ceil(F.size(h) / half).cast("int")

    def band(mask: int) -> Column:
        def minima(mixed: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), count - 1),
                               lambda p: F.array_min(F.slice(mixed, p * half + 1, WINDOW)))

        mixed = F.transform(h, lambda x: x.bitwiseXOR(F.lit(mask)))
        return F.get(F.transform(F.array(mixed), minima), F.lit(0))

    return F.when(F.size(h) > 0, F.concat(*map(band, MASKS))).otherwise(F.slice(h, 1, 0))


def template_table(spark: SparkSession, templates: Mapping[str, str]) -> list[tuple[str, list[int], list[str]]]:
    """(name, keys, shingles) of each template; as large as the templates are."""
    rows = _tokens(spark.createDataFrame(sorted(templates.items()), "name string, text string"))
    rows = rows.select("name", _strings(()).alias("strings"), shingles("_words", WIDTH, F.xxhash64).alias("hashes"))
    out = []
    for row in rows.collect():
        if len(row.hashes) < SHORT:
            keys = set(row.hashes)
        else:
            keys = {min(h ^ mask for h in row.hashes[k:k + WINDOW])
                    for mask in MASKS for k in range(len(row.hashes) - WINDOW + 1)}
        out.append((row.name, sorted(keys), row.strings))
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """One row per document: doc_id, found (array of struct(name, containment), by name)."""
    table = template_table(docs.sparkSession, templates)
    literal = F.from_json(F.lit(json.dumps([{"name": n, "keys": k, "shingles": s} for n, k, s in table])),
                          "array<struct<name:string,keys:array<bigint>,shingles:array<string>>>")
    short = [s[0].split(" ") for _, _, s in table if len(s) == 1 and s[0].count(" ") < WIDTH - 1]
    widths = sorted({len(words) for words in short})
    keys = F.from_json(F.lit(json.dumps(sorted({k for _, ks, _ in table for k in ks}))), "array<bigint>")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole().alias("text"))
    rows = _tokens(rows).withColumn("_hashes", shingles("_words", WIDTH, F.xxhash64))
    own = F.concat("_hashes", _window_keys("_hashes"), *[
        _hashed_runs(n, sorted({words[0] for words in short if len(words) == n})) for n in widths])
    rows = rows.withColumn("_met", F.array_intersect(own, keys))
    met = F.size("_met") > 0
    rows = rows.withColumn("_strings", F.when(met, _strings(widths)))

    def share(t: Column) -> Column:
        return F.struct(t["name"].alias("name"), (F.size(F.array_intersect(t["shingles"], F.col("_strings"))) / F.size(
            t["shingles"])).alias("containment"))

    candidates = F.filter(literal, lambda t: F.arrays_overlap(t["keys"], F.col("_met")))
    verified = F.filter(F.transform(candidates, share), lambda f: f["containment"] >= contained)
    none = F.array().cast("array<struct<name:string,containment:double>>")
    return rows.select("doc_id", F.when(met, verified).otherwise(none).alias("found"))


def license_matches(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (name:containment, comma-joined)."""
    found = F.transform("found", lambda f: F.concat(f["name"], F.lit(":"), F.format_number(f["containment"], 3)))
    return scan(docs).select("doc_id", F.size("found").cast("bigint").alias("n_licenses"),
                             F.array_join(found, ",").alias("licenses"))


def brute_force_sql(templates: Mapping[str, str] = TEMPLATES, contained: float = CONTAINED) -> str:
    """The same result without retrieval: every text against every template."""
    listed = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates.items())

    def tokens(text: str) -> str:
        lowered = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"list_filter(regexp_split_to_array({lowered}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

    shingled = (f"CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - {WIDTH - 2}, 2)), "
                f"lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) END")
    lengths = f"SELECT DISTINCT len(w) AS n FROM template WHERE len(w) < {WIDTH}"
    return f"""
WITH template AS (SELECT name, {tokens('text')} AS w FROM (VALUES {listed}) v(name, text)),
t AS (SELECT name, list_distinct({shingled}) AS s FROM template),
d AS (SELECT doc_id, {tokens('text')} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
e AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest({shingled}) AS s FROM d UNION ALL
    SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
    FROM d, ({lengths}) WHERE len(w) >= n)),
m AS (SELECT e.doc_id, u.name, count(*) / any_value(u.n) AS c FROM e
    JOIN (SELECT name, len(s) AS n, unnest(s) AS s FROM t) u ON e.s = u.s GROUP BY e.doc_id, u.name),
f AS (SELECT doc_id, count(*) AS n, string_agg(name || ':' || printf('%.3f', c), ',' ORDER BY name) AS l
    FROM m WHERE c >= {contained} GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.n, 0) AS n_licenses, coalesce(f.l, '') AS licenses FROM d LEFT JOIN f ON f.doc_id = d.doc_id"""
