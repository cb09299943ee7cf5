"""License scans: TF-IDF cosine to templates, then directory inheritance.

Units are the lines of every file (headers may stand anywhere in the text),
windows of ``WINDOWS`` consecutive lines with words (headers are wrapped; lines
of more than ``WIDE`` characters are not, and end a window), and the whole text
of licence files (by file name). Whole texts also meet the full licence texts
(``FULL_TEXTS``). Words are lower-cased
runs of letters and digits; ``idf = ln((N + 1) / (df + 1)) + 1`` over all
lines of all files.

1. One pass counts the lines that hold each word.
2. A line can only reach the cosine ``MIN_COSINE`` with a template if it holds
   one of the template's heavy words: the light ones together have a norm
   below that share of the template's (Cauchy-Schwarz), so lines without a
   heavy word are skipped without loss. Heavy words are few: they come from
   the templates, which are a bounded parameter.
3. The words of the remaining units meet the word weights and the templates
   in sparse joins; the best template of a file is its own licence. Among the
   GNU licences the unit's own words say which one it is, and its version
   (``stated_version``); an SPDX identifier counts as a cosine of 1.
4. The licence of a licence file holds for its directory. Each directory
   takes the nearest ancestor's (its own first), by a join on path prefixes;
   directories without a licence of their own are few compared with files, so
   the join on files is by directory only.

DataFrame functions only. A file at the root of relative paths lies in the
directory ``ROOT``, above all of them. Null texts have no units; null paths have
no directory; files without a licence and without an ancestor that has one get
nulls and ``via = 'none'``. Equal rows get equal results; a licence with its
version goes before one without, then the higher cosine, then the smaller name, for directories to the
smaller licence name. Columns other than path and text pass through; a clash
with an output column raises a ``ValueError``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cwescope.llm.common import store
from cwescope.llm.decontam import WORD_CHARS, words

# fixed values: statements by which files name their licence
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
                   "file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, "
                     "are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms "
            "of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "GNU General Public License version 2 as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General "
        "Public License as published by the Free Software Foundation, either version {1} of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public "
        "License along with this program.")
_TEXTS = Path(__file__).parent / "licence_texts"
_BSD, _MIT = ((_TEXTS / f"{name}.txt").read_text() for name in ("BSD-3-Clause", "MIT"))
# whole headers, paragraphs and short licences
TEMPLATES += (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("BSD-2-Clause", re.sub(r"(?s)3\. Neither.*?permission\.", "", _BSD)),
    ("BSD-3-Clause", _BSD),
    ("AGPL-3.0", _GNU.format("Affero ", "3")),
    ("GPL-2.0", _GNU.format("", "2")),
    ("GPL-3.0", _GNU.format("", "3")),
    ("LGPL-2.1", _GNU.format("Lesser ", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser ", "3")),
    ("MIT", _MIT),
    ("MIT", re.search("(?s)Permission is hereby.*?conditions:", _MIT)[0]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: Texts of which common words are a large part: only whole texts meet them.
FULL_TEXTS = tuple((name, (_TEXTS / f"{name}.txt").read_text()) for name in (
    "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"))
#: Lines of a window, in steps of at most half, and characters of a wrapped line.
WINDOWS = (2, 3, 4, 6, 9, 13, 18, 26)
WIDE = 160
LICENCE_FILE = "(?i)^(license|licence|copying|notice|unlicense)([.-].*)?$"
MIN_COSINE = 0.75
GNU_FAMILY = "^[AL]?GPL"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?[ \t]*([A-Za-z0-9.+-]+)"
#: The directory that relative paths start in.
ROOT = "."
OUTPUT = ("license", "cosine", "via", "from_dir")
#: Counts the lines among the words; no word holds it.
EVERY_LINE = "\n"


def unit_words(text: Column) -> Column:
    return words(F.lower(text))


def directory(path: Column) -> Column:
    """Path without its last part; ``ROOT`` for a path of one part."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(
        path.isNotNull(), F.lit(ROOT))


def ancestors(directory: Column) -> Column:
    """(depth, up) of a directory and all above it, up to the root of its tree."""
    parts = F.split(directory, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)),
                      lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit(ROOT).alias("up")))
    return F.when(F.startswith(directory, F.lit("/")) | (directory.isin("", ROOT)), own).otherwise(F.concat(root, own))


def stated_version(name: Column, text: Column) -> Column:
    """The licence that a unit's words name, if its template is one of the GNU
    family: these differ in a word and a number, which weigh little in a cosine.
    Without a version it is the family alone. ``text``: the words, joined."""
    family = F.when(F.contains(text, F.lit(" affero ")), "AGPL").when(
        text.rlike(" (lesser|library) general "), "LGPL").otherwise("GPL")
    version = F.regexp_extract(text, r" (?:version|v|gpl|gplv)\ ?(2 1|[123]) ", 1)
    number = F.when(version == "2 1", "2.1").otherwise(F.concat(version, F.lit(".0")))
    named = F.when(version == "", family).otherwise(F.concat(family, F.lit("-"), number))
    return F.when(name.rlike(GNU_FAMILY), named).otherwise(name)


def spdx_licences(files: DataFrame) -> DataFrame:
    """file, license, cosine (1) of files that state a licence by its SPDX
    identifier; the least one, as for equal cosines."""
    ids = F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))
    found = F.array_min(F.transform(ids, lambda x: F.regexp_replace(x, "(?i)(-only|-or-later|\\+)$", "")))
    return files.select("file", found.alias("license"), F.lit(1.0).alias("cosine")).where("license IS NOT NULL")


def line_counts(files: DataFrame) -> DataFrame:
    """word, df: lines that hold the word; the row ``EVERY_LINE`` counts them all."""
    lines = files.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return (lines.select(F.explode(F.array_append(F.array_distinct(unit_words(F.col("line"))),
                                                  F.lit(EVERY_LINE))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("df")))


def idf(df: Column, n: int) -> Column:
    return F.log(F.lit(float(n + 1)) / (df + 1)) + 1


def template_weights(counts: DataFrame, templates) -> tuple[int, dict[int, dict[str, float]], list[str]]:
    """Number of lines, unit-length weights of each template, heavy words."""
    tokens = [Counter(_template_words(t)) for _, t in templates]
    wanted = sorted({w for c in tokens for w in c})
    known = dict(counts.where(F.col("word").isin(*wanted, EVERY_LINE)).collect())  # bounded by the templates
    n = known.get(EVERY_LINE, 0)
    weights, heavy = {}, set()
    for i, c in enumerate(tokens):
        w = {t: k * (math.log((n + 1) / (known.get(t, 0) + 1)) + 1) for t, k in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        weights[i] = {t: x / norm for t, x in w.items()}
        light = 0.0
        # words of many lines first: the heavy ones are then rare in the files
        for t, x in sorted(weights[i].items(), key=lambda p: (-known.get(p[0], 0), p[1], p[0])):
            light += x * x
            if light >= (MIN_COSINE - 1e-9) ** 2:
                heavy.add(t)
    return n, weights, sorted(heavy)


def _template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def windows(lines: Column, heavy: Column) -> Column:
    """Windows of consecutive wrapped lines of which one has a word of
    ``heavy``, each joined by blanks. Lines without words (an empty comment
    line) are passed over."""
    wordy = F.filter(lines, lambda x: x.rlike(WORD_CHARS))
    rows = F.transform(wordy, lambda x: F.when(
        F.char_length(x) <= WIDE, F.struct(x.alias("x"), F.arrays_overlap(unit_words(x), heavy).alias("h"))))

    def of(rows: Column, size: int) -> Column:
        n = F.size(rows)
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda i: F.exists(F.slice(rows, i, size), lambda r: r["h"])
                          & ~F.exists(F.slice(rows, i, size), F.isnull))
        return F.transform(starts, lambda i: F.array_join(F.transform(F.slice(rows, i, size), lambda r: r["x"]), " "))

    # a variable of a lambda is computed once, an expression in it each time
    return F.flatten(F.transform(F.array(rows), lambda r: F.concat(*(of(r, size) for size in WINDOWS))))


def file_licences(files: DataFrame, templates=TEMPLATES, full_texts=FULL_TEXTS) -> DataFrame:
    """file (hash of path and text), template, cosine: the best template of
    each file that reaches ``MIN_COSINE`` in one of its units."""
    spark = files.sparkSession
    counts = store(line_counts(files), "license-df")
    n, weights, heavy = template_weights(counts, templates)
    _, full, heavy_full = template_weights(counts, full_texts)
    weights |= {len(templates) + i: w for i, w in full.items()}
    own = files.select(F.xxhash64("path", "text").alias("file"), "path", "text")
    name = F.regexp_extract("path", "[^/]*$", 0)
    any_heavy = F.array(*map(F.lit, heavy))
    lines = F.split("text", "\n", -1)
    # windows only of texts with a heavy word
    wrapped = F.when(F.arrays_overlap(unit_words(F.col("text")), any_heavy), windows(lines, any_heavy)) \
        .otherwise(F.array().cast("array<string>"))
    units = own.select("file", F.posexplode(F.concat(lines, wrapped)).alias("unit", "line"))
    units = units.select("file", "unit", unit_words(F.col("line")).alias("words"))
    units = units.where(F.arrays_overlap("words", any_heavy))
    whole = own.where(name.rlike(LICENCE_FILE)).select("file", F.lit(-1).alias("unit"),
                                                       unit_words(F.col("text")).alias("words"))
    units = units.unionByName(whole.where(
        F.arrays_overlap("words", F.array(*map(F.lit, sorted({*heavy, *heavy_full}))))))
    said = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    texts = units.where("unit >= 0").select("file", "unit", said.alias("said"))
    parts = units.select("file", "unit", F.explode("words").alias("word")) \
        .groupBy("file", "unit", "word").agg(F.count("*").alias("tf"))
    parts = store(parts, "license-words")
    lean = counts.join(parts.select("word").distinct(), "word", "left_semi")
    parts = parts.join(lean, "word", "left").withColumn(
        "x", F.col("tf") * idf(F.coalesce("df", F.lit(0)), n))
    table = spark.createDataFrame(
        [(i, t, x) for i, w in weights.items() for t, x in w.items()], "t int, word string, y double")
    norms = parts.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = parts.join(table, "word").groupBy("file", "unit", "t").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    dots = dots.where((F.col("unit") < 0) | (F.col("t") < len(templates)))
    names = F.array(*(F.lit(name) for name, _ in (*templates, *full_texts)))
    scored = store(dots.join(norms, ["file", "unit"]).select(
        "file", "unit", F.get(names, F.col("t")).alias("license"), cosine.alias("cosine"))
        .where(F.col("cosine") >= MIN_COSINE), "license-scored")
    gnu = F.col("license").rlike(GNU_FAMILY) & (F.col("unit") >= 0)
    named = scored.where(gnu).join(texts, ["file", "unit"]).withColumn(
        "license", stated_version(F.col("license"), F.col("said"))).drop("said")
    scored = scored.where(~gnu).unionByName(named).drop("unit").unionByName(spdx_licences(own))
    # a window without the version may be nearer to a template than one with it
    open_ = F.col("license").isin("GPL", "LGPL", "AGPL")
    best = F.min(F.struct(open_.alias("open"), (-F.col("cosine")).alias("c"), "license")).alias("b")
    return scored.groupBy("file").agg(best).select("file", "b.license", (-F.col("b.c")).alias("cosine"))


def scan(files: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``files`` (path, text, ...) with license, cosine, via ('header',
    'file', 'inherited' or 'none') and from_dir."""
    clash = [c for c in files.columns if c in OUTPUT or c in ("file", "dir")]
    if clash:
        raise ValueError(f"reserved column names in the input: {clash}")
    found = store(file_licences(files.select("path", "text"), templates), "license-files")
    rows = files.withColumn("file", F.xxhash64("path", "text")).withColumn("dir", directory(F.col("path")))
    is_licence = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE)
    granted = (rows.where(is_licence & F.col("dir").isNotNull()).select("file", "dir").distinct()
               .join(found, "file").groupBy("dir")
               .agg(F.min_by("license", F.struct(-F.col("cosine"), F.col("license"))).alias("license"))
               .select(F.col("dir").alias("from_dir"), F.col("license").alias("given")))
    dirs = rows.select("dir").where(F.col("dir").isNotNull()).distinct()
    reach = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.depth", "a.up")
    nearest = store(
        reach.join(granted, F.col("up") == F.col("from_dir"))
        .groupBy("dir").agg(F.max_by(F.struct("given", "from_dir"), "depth").alias("near"))
        .select(F.col("dir").alias("_dir"), "near.given", "near.from_dir"), "license-dirs")
    rows = rows.join(found, "file", "left").join(nearest, F.col("dir") == F.col("_dir"), "left")
    own = F.col("license").isNotNull()
    return rows.select(
        *files.columns, F.coalesce("license", "given").alias("license"), "cosine",
        F.when(own & is_licence, "file").when(own, "header")
        .when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("via"),
        F.when(~own, F.col("from_dir")).alias("from_dir"))


# ---- binding to the driver's documents ------------------------------------------

def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree source/lang/thousand. The documents whose
    id is divisible by 20 are notice files; they stand in turn in the
    directory of the source, of the language, and of the thousand."""
    i = F.col("doc_id")
    levels = [F.col("source"), F.col("lang"), F.floor(i / 1000).cast("string")]
    notice = i % 20 == 0
    depth = F.when(notice, (i / 20).cast("long") % 3 + 1).otherwise(3)
    name = F.concat(F.when(notice, "NOTICE-").otherwise("text-"), i.cast("string"))
    tree = F.slice(F.array(*(F.coalesce(x, F.lit("unknown")) for x in levels)), F.lit(1), depth.cast("int"))
    return docs.select("doc_id", F.concat_ws("/", F.array_join(tree, "/"), name).alias("path"), "text")


def license_report(docs: DataFrame) -> DataFrame:
    return scan(as_files(docs)).select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine"),
                                       "via", "from_dir")
