"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Each file is compared with short templates of known licences and headers.  Its
candidates are windows of consecutive lines around a line that holds a word of
licence language, so a notice inside a long text is judged by itself; the weight
of a term of the templates is its inverse document frequency over all files, at
most that of a term in one of ``RARE`` files, which is the weight of all other
terms: scores depend on shares of files, not on their number.  The best template
at or above ``THRESHOLD`` is the file's own licence.

A file named like a licence file, or one that consists of nothing but its notice,
speaks for its directory.  Files without a licence of their own
take that of the nearest ancestor directory which has one, found by joining each
file's ancestor paths with the directories; where a directory has several, the
highest score counts, ties by name.

Null or empty text: no licence of its own.  Null path: no directory, so nothing
is inherited.  Repeated rows each get the same result.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.functions.exprs import ident
from sheetloom.llm.base import add_columns, keep, ready, table, words_of

THRESHOLD = 0.5
#: A term weighs as if at least one of so many files had it.
RARE = 100
#: Lines of a candidate window, at most.
WINDOW = 4
NOTICE_WORDS = 100

#: Notices of well-known licences, as their authors ask for them to be stated.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT",
        "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a "
        "copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License, version 2."),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0. Creative Commons Attribution-NonCommercial 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0"),
    ("CC0-1.0",
        "To the extent possible under law, the author has dedicated all copyright and related rights to the "
        "public domain. CC0 1.0 Universal"),
    ("proprietary", "All rights reserved."),
)
#: What marks a line as licence language.
CUE = re.compile(r"licen[sc]e|copyright|all rights reserved|redistribution|permission is hereby|public domain|"
                 r"creative commons|spdx", re.I)
FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
_term = re.compile(r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*")

OWN = T.StructType([T.StructField("own_license", T.StringType()), T.StructField("score", T.DoubleType()),
                    T.StructField("whole", T.BooleanType())])
TERMS = T.StructType([T.StructField("terms", T.ArrayType(T.StringType()))])


def terms(text: str) -> list[str]:
    return _term.findall(text.lower())


VOCABULARY = frozenset(t for _, text in TEMPLATES for t in terms(text))


def document_frequencies(files: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of files, and files per term of the templates: counts over all files, a few hundred numbers."""

    def make():
        def run(column):
            return [[sorted(VOCABULARY.intersection(terms(x))) if x else [] for x in column.to_pylist()]]
        return run

    found = keep(add_columns(files.select(F.col(ident(text)).alias("text")), make, TERMS, "text").select("terms"))
    counts = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    return found.count(), {r["t"]: r["n"] for r in counts}


class Matcher:
    def __init__(self, n: int, df: dict[str, int]):
        self.n, self.df = n, df
        self.templates = [(name, self.vector(terms(t))) for name, t in TEMPLATES]

    def vector(self, found: list[str]) -> dict[str, float]:
        """Sparse unit vector; rare terms, and those of no template, weigh as if one of RARE files had them."""
        raw = {t: (1 + math.log(c)) * (1 + math.log((1 + self.n) / (1 + max(self.df.get(t, 1), self.n / RARE))))
               for t, c in Counter(found).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def best(self, text: str) -> tuple[str | None, float, bool]:
        """Best template over windows of lines that begin or end at a cue, its cosine, and whether the window is all."""
        lines = [x for x in text.split("\n") if x.strip()]
        cues = [i for i, x in enumerate(lines) if CUE.search(x)]
        best: tuple[float, str | None, bool] = (0.0, None, False)
        for i in cues:
            for a in range(max(0, i - WINDOW + 1), i + 1):
                for b in range(i + 1, min(len(lines), a + WINDOW) + 1):
                    v = self.vector(terms(" ".join(lines[a:b])))
                    for name, t in self.templates:
                        score = sum(w * v.get(k, 0.0) for k, w in t.items())
                        if score > best[0] + 1e-12:
                            best = score, name, b - a == len(lines)
        return (best[1], best[0], best[2]) if best[0] >= THRESHOLD else (None, best[0], False)


def own_licenses(files: DataFrame, n: int, df: dict[str, int], text: str = "text") -> DataFrame:
    """``files`` with ``own_license``, its ``score`` and ``whole`` (the text is nothing but its notice)."""
    ready(files.sparkSession)

    def make():
        matcher = Matcher(n, df)

        def run(column):
            found = [matcher.best(x) if x and CUE.search(x) else (None, 0.0, False) for x in column.to_pylist()]
            return [[f[i] for f in found] for i in range(3)]
        return run

    return add_columns(files, make, OWN, text)


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first: array of (depth, dir)."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(path.isNotNull(), F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir"))))


def license_scan(files: DataFrame, key: str = "id", path: str = "path", text: str = "text") -> DataFrame:
    """(key, path, own_license, score, license, license_dir): own licence, and that which holds after inheritance."""
    ready(files.sparkSession)
    source = files.select(F.col(ident(key)).alias("key"), F.col(ident(path)).cast("string").alias("path"),
                          F.col(ident(text)).alias("text"))
    n, df = document_frequencies(source)
    own = keep(own_licenses(source, n, df).drop("text"))
    speaks = F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(FILE) | F.col("whole"))
    dirs = (own.where(speaks).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
            .groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("score"), "own_license")).alias("dir_license")))
    # only paths without a licence look upwards; equal directories look once
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    asking = own.where("own_license IS NULL AND path IS NOT NULL").select(folder.alias("asks")).distinct()
    ladder = asking.select("asks", F.inline(ancestors(F.concat("asks", F.lit("/x")))))
    nearest = keep(ladder.join(dirs, "dir").groupBy("asks").agg(
        F.max_by(F.struct("dir_license", "dir"), "depth").alias("from")))
    looked = own.withColumn("folder", F.when(F.col("own_license").isNull(), folder))
    joined = looked.join(nearest, looked["folder"] == nearest["asks"], "left")
    return joined.select("key", "path", "own_license", "score",
                         F.coalesce("own_license", F.col("from.dir_license")).alias("license"),
                         F.col("from.dir").alias("license_dir"))


def op9_license_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of a tree.

    The table has no paths: source, language and thousand of the id stand for
    directories, and documents under ``NOTICE_WORDS`` words for their notices.
    """
    docs = table(spark, d, "documents")
    name = F.concat(F.when(words_of(F.col("text")) < NOTICE_WORDS, "NOTICE-").otherwise(""), F.col("doc_id"))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), name)
    found = license_scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id")
    return found.select(F.col("key").alias("doc_id"), "path", "own_license", "license", "license_dir")


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES: dict[str, str] = {}
