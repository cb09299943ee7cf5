"""Cosines and inheritance against a direct computation."""

import math
import random
import re
from collections import Counter

import pytest

from cwescope.llm import licenses as lic


def tokens(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.lower())


def stated(name, unit):
    if "GPL" not in name:
        return name
    words = tokens(unit)
    family = "AGPL" if "affero" in words else "LGPL" if "lesser" in words else "GPL"
    for a, b, c in zip(words, words[1:], words[2:] + [""]):
        if a == "version" and b in "123":
            return f"{family}-{'2.1' if (b, c) == ('2', '1') else b + '.0'}"
    return family


def brute(files):
    lines = [x for _, t in files if t is not None for x in t.split("\n")]
    df = Counter(w for x in lines for w in set(tokens(x)))
    n = len(lines)

    def vector(s):
        v = {w: k * (math.log((n + 1) / (df[w] + 1)) + 1) for w, k in Counter(tokens(s)).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    templates = [(name, vector(t)) for name, t in lic.TEMPLATES]

    def is_notice(p):
        return bool(p) and re.match(lic.LICENCE_FILE, p.split("/")[-1])

    own = []
    for path, text in files:
        units = [] if text is None else text.split("\n") + ([text] if is_notice(path) else [])
        scores = [(-round(sum(x * t.get(w, 0) for w, x in vector(u).items()), 9), stated(name, u))
                  for u in units for name, t in templates]
        scores = [s for s in scores if -s[0] >= lic.MIN_COSINE]
        scores += [(-1.0, re.sub("-only$|-or-later$", "", x)) for x in re.findall(
            r"SPDX-License-Identifier: ([\w.+-]+)", text or "")]
        best = min(((name in ("GPL", "LGPL", "AGPL"), c, name) for c, name in scores), default=None)
        own.append(best and best[1:])
    dirs = {}
    for (path, _), o in zip(files, own):
        if o and is_notice(path):
            d = path.rsplit("/", 1)[0] if "/" in path else "."
            dirs[d] = min(dirs.get(d, o), o)
    out = []
    for (path, _), o in zip(files, own):
        if o:
            out.append((path, o[1], round(-o[0], 6), "file" if is_notice(path) else "header", None))
            continue
        parts = path.split("/")[:-1] if path else []
        above = ["/".join(parts[:k]) for k in range(len(parts), 0, -1)] + (["."] if path and path[0] != "/" else [])
        up = next((d for d in above if d in dirs), None)
        out.append((path, dirs[up][1] if up else None, None, "inherited" if up else "none", up))
    return sorted(out, key=str)


def report(df):
    return sorted(((r.path, r.license, None if r.cosine is None else round(r.cosine, 6), r.via, r.from_dir)
                   for r in lic.scan(df).collect()), key=str)


def test_small_tree(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    words = "alpha beta gamma the of under this work version is public general"
    files = [
        ("a/LICENSE", mit), ("a/b/c/x.py", "code\nmore code"), ("a/b/NOTICE.txt", "hello\n" + gpl + "\nbye"),
        ("a/y.py", words), ("a/bc/z.py", None), ("d/e.py", "x\n" + gpl), ("d/f.py", ""), ("top", mit), (None, mit),
        (None, "x"), ("a/b/c/COPYING", "nothing here"), ("a/b/c/x.py", "code\nmore code"),
        ("g/LICENSE", mit + "\n" + gpl), ("g/h", words * 400), ("LICENSE", gpl), ("q", "x"), ("/abs/x", "y"),
        ("h/s.py", "# SPDX-License-Identifier: BSD-2-Clause"), ("h/t.py", "// SPDX-License-Identifier: GPL-2.0-or-later"),
    ] + [(f"f/{i}", f"{words}\nline {i} of the work") for i in range(60)]
    df = spark.createDataFrame(files, "path string, text string").repartition(3)
    assert report(df) == brute(files)


def test_tables(spark, sf):
    files = lic.as_files(spark.read.parquet(f"{sf}/documents.parquet"))
    got = brute([(r.path, r.text) for r in files.collect()])
    assert report(files) == got
    assert {v for *_, v, _ in got} >= {"header", "none"}


def test_names_and_empty_table(spark):
    df = spark.createDataFrame([("a", "b", 1)], "path string, text string, license int")
    with pytest.raises(ValueError):
        lic.scan(df)
    df = df.withColumnRenamed("license", "word")
    assert lic.scan(df).columns == ["path", "text", "word", "license", "cosine", "via", "from_dir"]
    assert lic.scan(df.limit(0)).count() == 0


def test_wrapped_headers_and_whole_licence_files(spark):
    import textwrap

    texts = {name: (lic._TEXTS / f"{name}.txt").read_text() for name in
             ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "BSD-3-Clause", "MIT")}
    heads = {"GPL-3.0": lic._GNU.format("", "3"), "GPL-2.0": lic._GNU.format("", "2"),
             "BSD-3-Clause": texts["BSD-3-Clause"], "Apache-2.0": dict(lic.TEMPLATES)["Apache-2.0"],
             "MPL-2.0": dict(lic.TEMPLATES)["MPL-2.0"]}
    rng = random.Random(3)
    prose = "the of and to in is for or that this any by with be not you work public general version terms".split()
    prose += [f"word{i}" for i in range(300)]

    def body(n):
        return "\n".join(" ".join(rng.choices(prose, k=10)) for _ in range(n))

    files, want = [], {}
    for name, text in texts.items():
        files += [(f"{name}/LICENSE", text), (f"{name}/src/a.c", body(5))]
        want |= {f"{name}/LICENSE": (name, "file"), f"{name}/src/a.c": (name, "inherited")}
    for name, head in heads.items():
        for mark, width in (("# ", 75), (" * ", 60), ("", 100)):
            path = f"x/{name}{width}.c"
            lines = [mark + x for x in textwrap.wrap(" ".join(head.split()), width)]
            files.append((path, "\n".join(["#!/bin/x", mark, *lines[:4], mark, *lines[4:], mark, body(30)])))
            want[path] = (name, "header")
    one = re.search("(?s)Permission is hereby.*?conditions:", texts["MIT"])[0]
    files += [("x/mit.py", "# " + " ".join(one.split())), ("y/NOTICE", body(200)), ("y/z.c", body(40))]
    want |= {"x/mit.py": ("MIT", "header"), "y/NOTICE": (None, "none"), "y/z.c": (None, "none")}
    files += [(f"p/{i}", body(20)) for i in range(40)]
    df = spark.createDataFrame(files, "path string, text string").repartition(4)
    got = {r.path: (r.license, r.via) for r in lic.scan(df).collect() if r.path in want}
    assert got == want


def test_headers_that_are_no_templates(spark):
    """Wrapped headers as files carry them; the version is the header's own."""
    gnu = """{name} is free software; you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation; {which}

{name} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details."""
    later = "either version {} of the License, or\n(at your option) any later version."
    isc = """Copyright (c) 2011 Some One

Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
    heads = {
        "GPL-2.0": [gnu.format(name="Tool", kind="", which=later.format(2)),
                    gnu.format(name="Tool", kind="", which="version 2 of the License."),
                    "GNU General Public License version 2\nas published by the\nFree Software Foundation"],
        "GPL-3.0": [gnu.format(name="This library", kind="", which=later.format(3))],
        "LGPL-2.1": [gnu.format(name="Tool", kind="Lesser ", which=later.format("2.1"))],
        "LGPL-3.0": [gnu.format(name="Tool", kind="Lesser ", which=later.format(3))],
        "AGPL-3.0": [gnu.format(name="Tool", kind="Affero ", which=later.format(3))],
        "ISC": [isc], "Apache-2.0": ["SPDX-License-Identifier: Apache-2.0"], "MIT": ["SPDX-License-Identifier: (MIT OR X)"],
        "GPL": [gnu.format(name="Tool", kind="", which="see the file COPYING.")],
    }
    rng = random.Random(8)
    prose = "the of and to in is for or that this any by with be not you work public general version terms".split()
    prose += [f"word{i}" for i in range(300)]

    def body(n):
        return "\n".join(" ".join(rng.choices(prose, k=10)) for _ in range(n))

    files, want = [], {}
    for name, texts in heads.items():
        for i, text in enumerate(texts):
            path = f"{name}/{i}.c"
            files.append((path, "/*\n" + "\n".join(" * " + x for x in text.split("\n")) + "\n */\n" + body(25)))
            want[path] = (name, "header")
    files += [(f"p/{i}", body(20)) for i in range(40)] + [("LICENSE", "Released under the MIT License."), ("src/a.py", "x")]
    want["src/a.py"] = ("MIT", "inherited")
    df = spark.createDataFrame(files, "path string, text string").repartition(4)
    got = {r.path: (r.license, r.via) for r in lic.scan(df).collect() if r.path in want}
    assert got == want
