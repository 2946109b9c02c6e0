"""Licence texts, tags and headers as they stand in files."""

import collections
import math
import random
import re
import textwrap

import pytest

from rowsight.llm import licences


def own(spark, files):
    found = licences.scan(spark.createDataFrame(files, "path string, text string")).collect()
    return {r.path: (r.licence, r.how) for r in found}


LONG = {name: re.sub(r"\s+", " ", text) for name, text in licences.TEMPLATES.items() if len(text) > 60 and "/tag" not in name}


@pytest.mark.parametrize("sign", ["", "# ", "// ", " * "])
def test_wrapped_headers(spark, sign):
    files, want = [], {}
    for name, text in LONG.items():
        for width in (40, 60, 80):
            lines = ["Copyright 2024 The Authors of This", ""] + textwrap.wrap(text, width - len(sign)) + ["", "import os", "print(os.name)"]
            files.append((f"src/{name}/{width}.py", "\n".join(sign + line for line in lines[:-3]) + "\n" + "\n".join(lines[-3:])))
            want[files[-1][0]] = (name.split("/")[0], "own")
    assert own(spark, files) == want


def test_tags_and_files(spark):
    mit = textwrap.fill(licences.TEMPLATES["MIT/text"].replace("\n", " "), 72)
    files = [
        ("a/x.c", "/* SPDX-License-Identifier: MIT */\nint main;"),
        ("b/x.c", "// SPDX-License-Identifier: GPL-3.0-or-later\nint main;"),
        ("c/x.c", "# SPDX-License-Identifier: GPL-2.0-only"),
        ("d/LICENSE", "MIT License\n\nCopyright (c) 2024 Jo Doe\n\n" + mit),
        ("d/deep/down/x.c", "int main;"),
        ("e/x.c", "Licensed under the Apache\nLicense, Version 2.0."),
        ("f/x.c", "All rights are fine\nwhere the licence of software is used with permission"),
        ("g/x.c", "permission to copy this software is a matter of the authors and of nobody else"),
        ("h/x.c", "# SPDX-License-Identifier: Nobody-Knows-1.0"),
        ("i/x.c", mit.upper()),
        ("j/x.c", "\n" * 5000 + "word " * 5000 + "\n" + "x\n" * 2000 + mit + "\n" + "word\n" * 2000),
        *[(f"k/{i}", word) for i, word in enumerate("mit MIT isc zlib unlicense 0BSD reserved license apache gpl cc0".split())],
    ]
    got = own(spark, files)
    assert all(v == (None, "none") for k, v in got.items() if k.startswith("k/"))
    assert got["a/x.c"] == ("MIT", "own") and got["b/x.c"] == ("GPL-3.0", "own") and got["c/x.c"] == ("GPL-2.0", "own")
    assert got["d/LICENSE"] == ("MIT", "own") and got["d/deep/down/x.c"] == ("MIT", "inherited")
    assert got["e/x.c"] == ("Apache-2.0", "own")
    assert got["f/x.c"] == got["g/x.c"] == got["h/x.c"] == (None, "none")
    assert got["i/x.c"] == got["j/x.c"] == ("MIT", "own")


def test_windows_are_all_found(spark):
    """Every line, window and whole licence file of small texts, scored one by one."""
    templates = {"A": "free to use by all", "B/text": "you may not copy or sell this work without the written consent of its owner", "C": "public domain"}
    vectors, threshold = licences.Vectors(templates, 0.6), 0.6
    words = "free to use by all you may not copy sell this work without written consent of its owner public domain x1 x2 x3".split()
    draw = random.Random(5)
    files = []
    for n in range(150):
        lines = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(1, 6))]
        if n % 3 == 0:
            lines[1:1] = textwrap.wrap(draw.choice(list(templates.values())), draw.choice([12, 20, 40]))
        files.append((f"d{n % 7}/{'LICENSE' if n % 5 == 0 else 'f'}-{n}", "\n".join(lines)))
    want = collections.defaultdict(dict)
    norms = {name: dict(v) for name, v in vectors.terms.items()}

    def look(path, part, lines, terms):
        if not terms:
            return
        w = {t: n * vectors.idf.get(t, vectors.unknown) for t, n in collections.Counter(terms).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        scores = [(-round(sum(x * v.get(t, 0) for t, x in w.items()) / norm, 6), name.split("/")[0]) for name, v in norms.items()]
        if -min(scores)[0] >= threshold:
            want[path][part, lines] = (min(scores)[1], -min(scores)[0])

    for path, text in files:
        rows = [(i, re.findall(licences.TERM, line)) for i, line in enumerate(text.split("\n"), 1)]
        rows = [r for r in rows if r[1]]
        for i, terms in rows:
            look(path, i, 1, terms)
        if "LICENSE" in path:
            look(path, 0, 0, [t for _, terms in rows for t in terms])
        for name, size in zip(templates, vectors.sizes):
            content = set(norms[name]) - licences.COMMON
            for k, (i, terms) in enumerate(rows):
                n, end = 0, k
                while end < len(rows) and n < size:
                    n, end = n + len(rows[end][1]), end + 1
                if end - k > 1 and content & set(terms):
                    look(path, i, end - k, [t for _, more in rows[k:end] for t in more])
    got = licences.matches(spark.createDataFrame(files, "path string, text string"), "path", "text", templates, threshold).collect()
    found = {(r.path, r.part, r.lines): (r.licence, r.score) for r in got}
    plain = {(path, *part): v for path, parts in want.items() for part, v in parts.items()}
    assert found.keys() == plain.keys() and len(found) > 60
    assert all(found[k][0] == plain[k][0] and abs(found[k][1] - plain[k][1]) < 1e-5 for k in plain)
