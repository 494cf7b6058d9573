"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import text_of
from loadloom.sources.stage import stage

# Short notices as the licences' own texts recommend them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.",
                 "Licensed under the GNU Affero General Public License, version 3."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Licensed under the Apache License, Version 2.0."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.",
                "This work is licensed under the GNU General Public License, version 2."),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
                "This work is licensed under the GNU General Public License, version 3."),
    "LGPL-3.0": ("This library is free software: you can redistribute it under the terms of the GNU Lesser General Public License, version 3.",
                 "Licensed under the GNU Lesser General Public License, version 3."),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "Released under the MIT License.", "Licensed under the MIT license."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
}
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
#: Words of a window over those of the longest template: at equal weights, with more the cosine is under 0.6 (1 / 0.6 ** 2 = 2.8).
LONGEST = 2.8
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")


def terms(text: str) -> Counter:
    """Word and word-pair counts of a block of text."""
    w = _TERM.findall(text.lower())
    return Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:]))


class Matcher:
    """Templates as unit TF-IDF vectors; terms that no template has get the largest weight, so prose scores low."""

    def __init__(self, df: dict[str, int], files: int):
        self.top = math.log(1 + files) + 1
        self.idf = {t: math.log((1 + files) / (1 + n)) + 1 for t, n in df.items()}
        self.rows: list[tuple[str, dict[str, float]]] = []
        for name, texts in sorted(TEMPLATES.items()):
            for text in texts:
                v = {t: n * self.idf.get(t, self.top) for t, n in terms(text).items()}
                norm = math.sqrt(sum(x * x for x in v.values()))
                self.rows.append((name, {t: x / norm for t, x in v.items()}))
        self.longest = math.ceil(LONGEST * max(len(_TERM.findall(x.lower())) for texts in TEMPLATES.values() for x in texts))
        every = sorted({t for _, v in self.rows for t in v})
        unit = {t: np.array([v.get(t, 0.0) for _, v in self.rows]) for t in every}
        self.squares = {t: x * x for t, x in unit.items()}
        self.weights = {t: x * self.idf.get(t, self.top) for t, x in unit.items()}

    def best(self, text: str) -> tuple[float, str | None]:
        """The best match of any window of consecutive lines; ties go to the first name.

        A window has one line, or as many as fit into ``longest`` words; lines without words do not count. A window's
        cosine is at most the root of its terms' share of the template, so starts are taken by that bound until none can win.
        """
        lines = [w for line in text.lower().split("\n") if (w := _TERM.findall(line))]
        if not lines:
            return 0.0, None
        wraps = [None, *(f"{a[-1]} {b[0]}" for a, b in zip(lines, lines[1:]))]
        inner = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in lines]
        mass = np.zeros((len(lines) + 1, len(self.rows)))
        for i, (ts, wrap) in enumerate(zip(inner, wraps), 1):
            for t in self.squares.keys() & {*ts, wrap}:
                mass[i] += self.squares[t]
        mass = np.cumsum(mass, axis=0)
        words = np.cumsum([0, *map(len, lines)])
        first = np.arange(len(lines))
        ends = np.maximum(np.searchsorted(words, words[:-1] + self.longest, side="right") - 1, first + 1)
        bound = np.minimum(1.0, (mass[ends] - mass[:-1]).max(1))
        best, name = 0.0, None
        for s in np.argsort(-bound, kind="stable").tolist():
            if bound[s] < best * best - 1e-9 or not bound[s]:
                break
            counts: dict[str, int] = {}
            norm, dots = 0.0, np.zeros(len(self.rows))
            for e in range(s, int(ends[s])):
                for t in inner[e] if e == s else [wraps[e], *inner[e]]:
                    n = counts.get(t, 0)
                    counts[t] = n + 1
                    norm += (2 * n + 1) * self.idf.get(t, self.top) ** 2
                    if t in self.weights:
                        dots += self.weights[t]
                i = int(dots.argmax())  # rows are sorted by name
                c = float(dots[i]) / math.sqrt(norm)
                if c > best + 1e-12 or c > best - 1e-12 and name is not None and self.rows[i][0] < name:
                    best, name = c, self.rows[i][0]
        return best, name


def template_frequencies(files: DataFrame, text_col: str) -> tuple[dict[str, int], int]:
    """In how many files each template term occurs, and the number of files."""
    wanted = {t for texts in TEMPLATES.values() for x in texts for t in terms(x)}

    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0):
                n.update(wanted & terms(t.as_py()).keys())
            yield pa.RecordBatch.from_arrays([pa.array(["", *n]), pa.array([b.num_rows, *n.values()], pa.int64())], ["term", "n"])

    rows = files.select(text_of(text_col)).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n")).collect()
    df = dict(map(tuple, rows))
    return {t: n for t, n in df.items() if t}, df.get("", 0)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """(doc_id, path, license, cosine, origin, inherited_from) of every file.

    A file whose best window of lines reaches ``threshold`` has that licence (origin ``header``, or ``file`` if its name is a
    licence file's). Other files take it from the nearest ancestor directory with a
    licence file that has one (``inherited``; the higher cosine, then the first name decides between several), else none.
    A path is exploded to its ancestors, bounded by its depth, and joined to the directories.
    Null texts match nothing; a null path inherits nothing; repeated rows are all returned; other columns are ignored; no rows give no rows.
    """
    df, n = template_frequencies(files, text_col)
    matcher = Matcher(df, n)
    kind = dict(files.dtypes)[id_col]

    def run(batches):
        for b in batches:
            got = [matcher.best(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.float64()),
                                              pa.array([g[1] if g[0] >= threshold else None for g in got], pa.string())], ["doc_id", "path", "cosine", "license"])

    own = stage(files.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), text_of(text_col).alias("text"))
                .mapInArrow(run, f"doc_id {kind}, path string, cosine double, license string"))
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
    is_file = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    folders = (own.where(is_file & F.col("license").isNotNull()).withColumn("folder", folder)
               .groupBy("folder").agg(F.min(F.struct(-F.col("cosine"), "license")).alias("best")).select("folder", F.col("best.license").alias("given")))
    split = F.split(folder, "/")
    ancestors = F.when(folder == "", F.array(F.lit(""))).otherwise(F.array_append(F.transform(F.sequence(F.lit(1), F.size(split)), lambda k: F.array_join(F.slice(split, 1, k), "/")), F.lit("")))
    near = (own.where("license IS NULL AND path IS NOT NULL").select(folder.alias("own_folder")).distinct()
            .withColumn("path", F.concat("own_folder", F.lit("/x"))).select("own_folder", F.explode(ancestors).alias("folder"))
            .join(folders, "folder").groupBy("own_folder").agg(F.max(F.struct(F.length("folder"), "folder", "given")).alias("near"))
            .select("own_folder", "near.folder", "near.given"))
    near = stage(near)
    out = own.withColumn("own_folder", F.when(F.col("license").isNull(), folder)).join(near, "own_folder", "left")
    origin = F.when(F.col("license").isNotNull(), F.when(is_file, "file").otherwise("header")).when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("license", "given").alias("license"), "cosine", origin.alias("origin"),
                      F.when(F.col("license").isNull(), F.col("folder")).alias("inherited_from"))
