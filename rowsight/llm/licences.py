"""Licence scan: TF-IDF cosine to templates, then inheritance from directories.

Every line of every file, every window of lines and the whole of a licence file are
compared with all templates: short notices, tags, standard headers, titles and texts of
licences. A window is for one template: it begins at a line that has a term of the
template other than a function word, and takes whole lines until it has as many terms as
the template; lines without terms (blank ones, bare comment signs) don't count. So a
notice is found however its lines are wrapped, if it begins with a line.

Term weights come from the templates; a term that no template has counts with the
largest weight. What cannot reach the threshold is passed over exactly: a template's
chosen terms are such that without any of them its other terms don't add up to the
threshold. A file without a licence of its own takes that of the nearest directory above
it that has a licence file, found by joining paths.

All of it is DataFrame operations. Templates are a parameter, their tables are literals
or broadcast and have one row for each term of a template.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from rowsight.functions.scalars import col
from rowsight.llm.shared import settled

#: fixed values: identifiers, short notices, standard headers, titles and texts of licences.
#: A name is a licence, or a licence and what the template is of it.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "Unlicense": "Released into the public domain.",
    "Proprietary": "All rights reserved.",
    "Apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0/title": """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
        TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION""",
    "AGPL-3.0/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "AGPL-3.0/title": """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
        Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
    "BSD-2-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
        OF SUCH DAMAGE.""",
    "BSD-3-Clause/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
        OF SUCH DAMAGE.""",
    "GPL-2.0/header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0/title": """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.
        Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
    "GPL-3.0/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0/title": """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
        Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
    "ISC/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
        OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-3.0/header": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0/title": """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
        Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
    "MIT/notice": "Licensed under the MIT License.",
    "MIT/grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions:""",
    "MIT/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    "MPL-2.0/header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense/text": """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib/text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
        and to alter it and redistribute it freely, subject to the following restrictions""",
}
#: fixed values: identifiers that stand in tags
TAGGED = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 "
    "CC0-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
TEMPLATES |= {re.sub("-(only|or-later)$", "", name) + f"/tag {name}": f"SPDX-License-Identifier: {name}" for name in TAGGED}
#: function words: any choice of the terms that may miss keeps the filter exact, these keep it narrow
COMMON = set("a all an and any as at be by for from in into is it no not of on or out the this to under with work you your".split())
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
#: file names that hold a directory's licence
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"


class Vectors:
    """Term weights of the templates."""

    def __init__(self, templates: dict[str, str], threshold: float):
        counts = {name: Counter(re.findall(TERM, text.lower())) for name, text in templates.items()}
        # tags are one document: else the words that make a tag would weigh next to nothing, and an identifier alone would do
        families: dict[str, set[str]] = {}
        for name, c in counts.items():
            families.setdefault("tag" if "/tag " in name else name, set()).update(c)
        documents = Counter(t for terms in families.values() for t in terms)
        n = len(families)
        self.idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in documents.items()}
        self.unknown = math.log(1 + n) + 1
        self.rows, self.heavy, self.terms, self.threshold = [], set(), {}, threshold
        self.sizes = [sum(c.values()) for c in counts.values()]
        for name, c in counts.items():
            weights = {t: k * self.idf[t] for t, k in c.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.terms[name] = [(t, w / norm) for t, w in weights.items()]
            self.rows += [(t, name, w) for t, w in self.terms[name]]
            light = 0.0
            for t, w in sorted(weights.items(), key=lambda x: (x[0] not in COMMON, x[1], x[0])):
                light += (w / norm) ** 2
                if math.sqrt(light) >= threshold - 1e-9:
                    self.heavy.add(t)

    def squares(self, given: Collection[str] = COMMON) -> tuple[dict[str, list[float]], list[float]]:
        """The squared weights of each term in all templates, and each template's sum over the terms ``given``."""
        table, base = {t: [0.0] * len(self.terms) for t in self.idf if t not in given}, [0.0] * len(self.terms)
        for i, terms in enumerate(self.terms.values()):
            for t, w in terms:
                if t in given:
                    base[i] += w * w
                else:
                    table[t][i] = w * w
        return table, base


def _sum(i: Column, terms: Column, squares: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.get(F.element_at(squares, t), i))


def _literal(value: object, type_: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), type_)


def parts(files: DataFrame, path: str, text: str, vectors: Vectors) -> DataFrame:
    """(path, body, part, lines, terms): lines, windows of lines and whole licence files that may reach the threshold.

    A cosine is at most the norm of the template's terms that are present. For whole
    files, and for windows before their terms are put together, function words count
    as present; what is left is then looked at with all its terms.
    """
    heavy = "|".join(re.escape(t) for t in sorted(vectors.heavy))
    said = F.col("text").rlike(rf"(?<![a-z0-9])(?:{heavy})(?![a-z0-9])")
    whole = files.select(col(path).cast("string").alias("path"), F.lower(col(text).cast("string")).alias("text"), F.xxhash64(col(text)).alias("body"))
    whole = whole.where(F.col("path").isNotNull() & said)
    squares, base = vectors.squares()
    content, every = _literal(sorted(squares), "array<string>"), _literal(sorted(vectors.idf), "array<string>")
    table, given, sizes = _literal(squares, "map<string,array<double>>"), _literal(base, "array<double>"), _literal(vectors.sizes, "array<int>")
    least, ids = F.lit(vectors.threshold**2 - 1e-9), F.sequence(F.lit(0), F.lit(len(base) - 1))
    # generators and not filters: a filter would be pushed below and take the terms out of each text again
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("part"), F.regexp_extract_all(x, F.lit(TERM), F.lit(0)).alias("terms")))
    rows = whole.select("path", "body", F.explode(F.array(F.filter(split, lambda r: F.size(r["terms"]) > 0))).alias("rows"))
    words = F.array_intersect(F.flatten(F.transform("rows", lambda r: r["terms"])), content)
    rows = rows.select("path", "body", "rows", F.explode(F.array(words)).alias("words"))
    able = F.aggregate(F.col("words"), given, lambda s, t: F.zip_with(s, F.element_at(table, t), lambda a, b: a + b), lambda s: F.filter(ids, lambda i: F.get(s, i) >= least))
    rows = rows.select("path", "body", "rows", F.explode(F.filter(F.array(able), lambda a: F.size(a) > 0)).alias("able"))

    def weighed(r: Column) -> Column:
        said = F.array_intersect(r["terms"], content)
        return F.struct(r["part"].alias("part"), r["terms"].alias("terms"), F.size(r["terms"]).alias("n"), F.transform("able", lambda i: _sum(i, said, table)).alias("s"))

    rows = rows.select("path", "body", "able", F.explode(F.array(F.transform("rows", weighed))).alias("rows"))

    def part(number: Column, lines: Column, terms: Column) -> Column:
        return F.struct(number.cast("int").alias("part"), lines.cast("int").alias("lines"), terms.alias("terms"))

    singles = F.transform(
        F.filter("rows", lambda r: F.exists(F.arrays_zip(F.col("able").alias("i"), r["s"].alias("s")), lambda x: F.get(given, x["i"]) + x["s"] >= least)),
        lambda r: part(r["part"], F.lit(1), r["terms"]),
    )

    def window(i: Column, j: Column, r: Column, k: Column) -> Column:
        size = F.get(sizes, i)
        start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("lines"))
        more = lambda a, x: F.when(a["n"] < size, F.struct((a["n"] + x["n"]).alias("n"), (a["s"] + F.get(x["s"], j)).alias("s"), (a["lines"] + 1).alias("lines"))).otherwise(a)
        taken = lambda a: F.when(
            (a["lines"] > 1) & (F.get(given, i) + a["s"] >= least),
            part(r["part"], a["lines"], F.flatten(F.transform(F.slice("rows", k + 1, a["lines"]), lambda x: x["terms"]))),
        )
        return F.when((F.get(r["s"], j) > 0) & (r["n"] < size), F.aggregate(F.slice("rows", k + 1, size), start, more, taken))

    windows = F.flatten(F.transform("able", lambda i, j: F.filter(F.transform("rows", lambda r, k: window(i, j, r, k)), lambda w: w.isNotNull())))
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    files_ = F.when(named, F.array(part(F.lit(0), F.lit(0), F.flatten(F.transform("rows", lambda r: r["terms"]))))).otherwise(F.expr("array()"))
    found = rows.select("path", "body", F.explode(F.concat(singles, windows, files_)).alias("p")).select("path", "body", "p.*")
    found = found.select("path", "body", "part", "lines", "terms", F.explode(F.array(F.array_intersect("terms", every))).alias("present"))
    all_squares = _literal(vectors.squares(())[0], "map<string,array<double>>")
    nothing = _literal([0.0] * len(base), "array<double>")
    reaches = F.aggregate(F.col("present"), nothing, lambda s, t: F.zip_with(s, F.element_at(all_squares, t), lambda a, b: a + b), lambda s: F.exists(s, lambda a: a >= least))
    return found.select("path", "body", "part", "lines", F.explode(F.when(reaches, F.array("terms"))).alias("terms")).distinct()


def matches(files: DataFrame, path: str, text: str, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(path, body, part, lines, licence, score): the best template of each part that reaches ``threshold``.

    part: the number of a part's first line, from 1, or 0 for the whole text of a file
    that is named as a licence. lines: how many lines with terms it has (0: whole text).
    Equal scores go to the licence that comes first by name. body is a hash of the
    text, so that files with one path are told apart.
    """
    vectors = Vectors(templates or TEMPLATES, threshold)
    terms = parts(files, path, text, vectors).select("path", "body", "part", "lines", F.explode("terms").alias("term"))
    counted = terms.groupBy("path", "body", "part", "lines", "term").agg(F.count("*").alias("n"))
    spark = files.sparkSession
    idf = F.broadcast(spark.createDataFrame(list(vectors.idf.items()), "term string, idf double"))
    weighted = settled(counted.join(idf, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(vectors.unknown))))
    norm = weighted.groupBy("path", "body", "part", "lines").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    table = F.broadcast(spark.createDataFrame(vectors.rows, "term string, licence string, weight double"))
    dots = weighted.join(table, "term").groupBy("path", "body", "part", "lines", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scores = dots.join(norm, ["path", "body", "part", "lines"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    scores = scores.withColumn("licence", F.substring_index("licence", "/", 1))
    best = F.min_by("licence", F.struct(-F.col("score"), "licence"))
    return scores.groupBy("path", "body", "part", "lines").agg(best.alias("licence"), F.max("score").alias("score"))


def _directory(path: Column) -> Column:
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """path, ``keep``, licence, score, how and licence_dir of each row of ``files``.

    how: 'own' (its best part reaches the threshold), 'inherited' (from licence_dir, the
    nearest directory at or above its own with a licence file that has a licence), or
    'none'. A directory's licence is that of its best licence file, ties to the smaller
    licence. Null and empty texts have no licence of their own; null paths inherit
    nothing. Rows that repeat a path and text are answered alike.
    """
    found = settled(matches(files, path, text, templates, threshold))
    best = F.min_by("licence", F.struct(-F.col("score"), "licence")).alias("licence"), F.max("score").alias("score")
    own = found.groupBy("path", "body").agg(*best)
    is_file = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)
    of_dirs = found.where(is_file).groupBy(_directory(F.col("path")).alias("above")).agg(*best)
    # directories, not files, look for the nearest licence: each has few above it
    dirs = files.where(col(path).isNotNull()).select(_directory(col(path).cast("string")).alias("dir")).distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size("steps")), lambda n: F.array_join(F.slice("steps", 1, n), "/"))
    climbs = dirs.withColumn("steps", steps).select("dir", F.posexplode(above).alias("depth", "above")).distinct()
    nearest = climbs.join(of_dirs, "above").groupBy("dir").agg(F.max_by(F.struct("above", "licence", "score"), "depth").alias("near"))
    rows = files.select(*[col(k) for k in keep], col(path).cast("string").alias("path"), F.xxhash64(col(text)).alias("__body"))
    rows = rows.withColumn("__dir", _directory(F.col("path")))
    own = own.select(F.col("path").alias("__path"), F.col("body").alias("__b"), F.col("licence").alias("__licence"), F.col("score").alias("__score"))
    # a directory may hold a third of all files: the join is by sort-merge, which adaptive execution splits
    joined = rows.join(own, (F.col("path") == F.col("__path")) & (F.col("__body") == F.col("__b")), "left").join(nearest, F.col("__dir") == F.col("dir"), "left")
    mine = F.col("__licence").isNotNull()
    return joined.select(
        *[col(k) for k in keep], "path",
        F.when(mine, F.col("__licence")).otherwise(F.col("near.licence")).alias("licence"),
        F.when(mine, F.col("__score")).otherwise(F.col("near.score")).alias("score"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~mine, F.col("near.above")).alias("licence_dir"),
    )
