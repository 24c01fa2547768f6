"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them. JVM expressions only.

Words are runs of letters and digits in lower case, a shingle is five of them. A template of S shingles is looked for by windows of c
shingles, where c, of 1, 4 and 16, is the largest with c + c / 2 - 1 <= S; a text's windows start at every c / 2 shingles, the template's
at every one. An unchanged passage of c + c / 2 - 1 shingles of a template therefore holds a window of the text that equals one of the
template's, which collides in every band, whatever the hash functions; windows of Jaccard likeness J collide in one of the bands of one
row each with probability 1 - (1 - J) ** BANDS (0.998 at 0.8). A long template with scattered changes has many windows, each with that
chance.

A retrieved template is verified once an occurrence. Its shingles' places in the text less their places in the template are offsets; sorted,
they fall into occurrences wherever two neighbours differ by more than a quarter of the template's shingles. Of an occurrence's shingles
that stand twice in it the one nearest to its median offset counts. In the stretch of text that the template fills at these offsets the
share of its shingles is counted exactly; from `least` (0.75) on it is a match, reported from the first to the last word that it holds. All
of this is linear in the text and the template but for sorting: places come from a hash table that is one constant of the plan.

Templates, full licence texts or single statements, are a parameter; their shingles are constants of the plan, some fifty bytes each in each
task. Documents are never shuffled or joined.

Edge cases: a null text is an empty one; a text or template of fewer than five words has no shingle (such a template is refused);
repeated rows are scanned each for itself; other columns are neither read nor returned; an empty table gives an empty result. A template that
stands twice in a text gives two matches; passages of more than a quarter of it put in at one place cut an occurrence in two; of overlapping
matches of one template the one with the larger share stays, the first of equals. Templates that hold each other (BSD-2 in BSD-3) both match.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import let

#: Public licence statements and texts, by name.
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LICENSES = {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
    (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
    distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software. """ + WARRANTY,
    "BSD-2-text": BSD_CONDITIONS + " " + BSD_WARRANTY,
    "BSD-3-text": BSD_CONDITIONS + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission. """ + BSD_WARRANTY,
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
    the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
    WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
    FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
    ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
    sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
    means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
    software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
    We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
    law. """ + WARRANTY,
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
    damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
    applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
    misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
    documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
    as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
WORD = r"[\p{L}\p{N}]+"
K, BANDS, CLASSES = 5, 4, (1, 4, 16)


def class_of(shingles: int) -> int:
    return max(c for c in CLASSES if c + c // 2 - 1 <= shingles or c == 1)


def shingle_hashes(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    rolled = lambda h: F.transform(F.slice(h, F.lit(1), F.size(h) - (K - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]))
    return let(words, lambda h: F.when(F.size(h) < K, F.array().cast("array<bigint>")).otherwise(rolled(h)))


def minima(hashed: Column, c: int, stride: int) -> Column:
    """Minimum of each window of c values that starts at a multiple of stride (1 or c / 2), shorter at the end."""
    if stride == 1:
        return F.transform(hashed, lambda _, i: F.array_min(F.slice(hashed, i + 1, F.lit(c))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hashed) - 1) / stride).cast("int")), lambda i: F.array_min(F.slice(hashed, i * stride + 1, F.lit(stride))))
    return let(blocks, lambda b: F.zip_with(b, F.slice(b, F.lit(2), F.size(b)), lambda x, y: F.least(x, y)))


def template_tables(spark: SparkSession, templates: dict[str, str]) -> tuple[dict[str, list[int]], dict[tuple[int, int], dict[int, set[str]]]]:
    """Shingle hashes of each template in order, and for each class and band the names behind each window minimum. A few rows, in the JVM."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string").select("name", shingle_hashes(F.col("text")).alias("s"))
    each = rows.select("name", "s", *[let(_hashed("s", j), _windows(c)).alias(f"m{c}_{j}") for c in CLASSES if c > 1 for j in range(BANDS)]).collect()
    shingles: dict[str, list[int]] = {}
    keys: dict[tuple[int, int], dict[int, set[str]]] = {}
    for r in each:
        if not r["s"]:
            raise ValueError(f"template {r['name']} has fewer than {K} words")
        shingles[r["name"]] = list(r["s"])
        c = class_of(len(r["s"]))
        for j in range(BANDS if c > 1 else 1):
            found = r["s"] if c == 1 else r[f"m{c}_{j}"][: len(r["s"]) - c + 1]
            for x in found:
                keys.setdefault((c, j), {}).setdefault(x, set()).add(r["name"])
    return shingles, keys


def anchors(shingles: list[int]) -> dict[int, int]:
    """Place of each shingle that occurs once in a template; of all shingles, at their first places, where these are fewer than half."""
    times, first = Counter(shingles), {}
    for p, h in enumerate(shingles):
        first.setdefault(h, p)
    once = {h: p for h, p in first.items() if times[h] == 1}
    return once if 2 * len(once) >= len(first) else first


def _hashed(s: str | Column, j: int) -> Column:
    return F.transform(s, lambda x: F.xxhash64(x, F.lit(j)))


def _windows(c: int):
    return lambda h: minima(h, c, 1)


def constant(rows: list, kind: str) -> Column:
    """A value of that type, folded to one literal."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


def hash_table(entries: list[dict], fields: str) -> Callable[[Column], Column]:
    """A function from a hash to the entries whose `h` it is: an array of buckets, two for each entry, in the plan."""
    n = 2 * len(entries) + 1
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for e in entries:
        buckets[e["h"] % n].append(e)
    table = constant(buckets, f"array<array<struct<h:bigint,{fields}>>>")
    return lambda x: F.filter(F.get(table, F.pmod(x, F.lit(n).cast("long")).cast("int")), lambda e: e["h"] == x)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = LICENSES, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75) -> DataFrame:
    """id_col and `found` for each row: array of (first, last, name, share), the words from first to last (exclusive) hold that share of the template."""
    shingles, keys = template_tables(docs.sparkSession, templates)
    names = sorted(shingles)
    placed = [anchors(shingles[n]) for n in names]
    distinct = [sorted(set(shingles[n])) for n in names]
    own, lengths, labels = constant(distinct, "array<array<bigint>>"), constant([len(shingles[n]) for n in names], "array<int>"), constant(names, "array<string>")
    gaps = constant([max(1, len(shingles[n]) // 4) for n in names], "array<int>")
    needed = constant([max(1, ceil(least * len(d)) - (len(d) - len(a))) for d, a in zip(distinct, placed, strict=True)], "array<int>")
    places = hash_table([{"h": h, "t": t, "p": p} for t, a in enumerate(placed) for h, p in a.items()], "t:int,p:int")

    def retrieved(s: Column) -> Column:
        """Numbers of the templates of which a window collides in a band."""
        kinds = []
        for (c, j), table in sorted(keys.items()):
            stride = max(1, c // 2)
            behind = hash_table([{"h": h, "t": sorted(names.index(n) for n in those)} for h, those in table.items()], "t:array<int>")
            kinds.append(let(s if c == 1 else let(_hashed(s, j), _strided(c, stride)), _hits(sorted(table), behind)))
        return F.array_distinct(F.concat(*kinds))

    def verified(s: Column, wanted: Column) -> Column:
        """Matches of the wanted templates."""
        each = lambda i: F.transform(F.filter(places(F.get(s, i)), lambda e: F.array_contains(wanted, e["t"])), lambda e: F.struct(e["t"].alias("t"), (i - e["p"]).alias("off"), i.alias("i"), e["p"].alias("p")))
        found = F.sort_array(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 1), each)))
        groups = let(found, lambda e: let(_starts(e, gaps), lambda at: F.transform(at, lambda j, k: F.slice(e, j + 1, F.coalesce(F.get(at, k + 1), F.size(e)) - j))))
        enough = F.filter(groups, lambda g: F.size(g) >= F.get(needed, g[0]["t"]))
        occurrences = F.transform(enough, lambda g: let(_offsets(g), lambda o: _match(s, F.get(own, o["t"]), F.get(lengths, o["t"]), o, F.get(labels, o["t"]))))
        return F.array_sort(let(F.sort_array(F.filter(occurrences, lambda m: m["share"] >= least)), _apart))

    none = F.array().cast(FOUND)
    whole = lambda s: let(retrieved(s), lambda t: F.when(F.size(t) == 0, none).otherwise(verified(s, t)))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`"), let(shingle_hashes(text), lambda s: F.when(F.size(s) == 0, none).otherwise(whole(s))).alias("found"))


FOUND = "array<struct<first:int,last:int,name:string,share:double>>"


def _strided(c: int, stride: int):
    return lambda h: minima(h, c, stride)


def _hits(known: list[int], behind: Callable[[Column], Column]):
    return lambda m: F.flatten(F.flatten(F.transform(F.filter(m, lambda x: x.isin(known)), lambda x: F.transform(behind(x), lambda e: e["t"]))))


def _starts(e: Column, gaps: Column) -> Column:
    """Where occurrences start among sorted (template, offset, ..)."""
    new = lambda a, b: (a["t"] != b["t"]) | (b["off"] - a["off"] > F.get(gaps, b["t"]))
    every = F.when(F.size(e) > 0, F.sequence(F.lit(0), F.size(e) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda j: (j == 0) | new(F.get(e, j - 1), F.get(e, j)))


def _offsets(g: Column) -> Column:
    """Template, least and greatest offset of an occurrence, each place of the template taken where it is nearest to the median offset."""
    middle = F.get(g, F.floor(F.size(g) / 2).cast("int"))["off"]
    near = let(middle, lambda m: F.sort_array(F.transform(g, lambda x: F.struct(x["p"].alias("p"), F.abs(x["off"] - m).alias("d"), x["off"].alias("off")))))
    once = let(near, lambda a: F.filter(a, lambda x, k: (k == 0) | (F.get(a, k - 1)["p"] != x["p"])))
    return let(F.transform(once, lambda x: x["off"]), lambda o: F.struct(g[0]["t"].alias("t"), F.array_min(o).alias("low"), F.array_max(o).alias("high")))


def _match(s: Column, mine: Column, length: Column, o: Column, name: Column) -> Column:
    """(name, first, last, share) in the stretch that the template fills at these offsets."""
    start = F.greatest(o["low"], F.lit(0))

    def of(a: Column) -> Column:
        front, back = F.array_intersect(a, mine), let(F.reverse(a), lambda r: F.array_position(r, F.get(F.array_intersect(r, mine), 0)))
        first = start + F.array_position(a, F.get(front, 0)) - 1
        return F.struct(name.alias("name"), first.cast("int").alias("first"), (start + F.size(a) - back + K).cast("int").alias("last"), (F.size(front) / F.size(mine).cast("double")).alias("share"))

    return let(F.slice(s, start + 1, o["high"] + length - start), of)


def _apart(m: Column) -> Column:
    """Of sorted matches those that no neighbour of the same name overlaps with a larger share, the first of equals, as (first, last, name, share)."""
    over = lambda x, y: F.coalesce((x["name"] == y["name"]) & (x["first"] < y["last"]) & (y["first"] < x["last"]), F.lit(False))
    worse = lambda x, k: (over(x, F.get(m, k - 1)) & (F.get(m, k - 1)["share"] >= x["share"])) | (over(x, F.get(m, k + 1)) & (F.get(m, k + 1)["share"] > x["share"]))
    return F.transform(F.filter(m, lambda x, k: ~worse(x, k)), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["name"].alias("name"), x["share"].alias("share")))
