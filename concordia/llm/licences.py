"""Licence scans: notices of licence templates in documents, by MinHash bands.

Method: a text's 5-word shingles are cut into overlapping windows of the size of
each class of templates; windows and templates that agree in a MinHash band are
candidates, and a candidate is verified by exact containment: at least ``PERCENT``
percent of the template's shingles stand in the window (and a window's half
around it), among them one that holds its version and one that holds its name
where other licences' names resemble it: version 2 is not found as version 3.

Windows: a class is a step ``q`` and ``m`` blocks of it.  With m = 5, windows of
5 q shingles every q shingles have any run of up to 4 q + 1 shingles whole in one
of them.  Bands are of one row, and a class has as many as its worst case needs
to collide with probability ``SURE``: a template of the class's least size, just
contained enough, in a window of full size.

The hash of band j is x -> x XOR c_j on shingle hashes, so a window's band value
belongs to one of its shingles.  A window that collides therefore holds a
shingle that is a minimum of some template: signatures are made for the windows
around such shingles only, and no other window could collide.  The main path is
DataFrame functions alone; the templates are a parameter of bounded size (their
shingles are literals and a broadcast table, ``MAX_SHINGLES`` at most).

Defined cases
* words are runs of letters and digits, lower-cased; null or empty text, or one
  of fewer than five words, holds nothing; a template of fewer than five words
  is an error;
* rows with the same ``doc_id`` count as one document, so do those without one;
* several templates of a licence give one row; an empty table gives an empty one;
* texts are scanned whole, whatever their length; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import table

WORDS = 5
PERCENT = 80
SURE = 0.999
MAX_SHINGLES = 100_000

# Notices as licences word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License "
                   "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
                   "express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


# Names of licences that differ by a word in them.
NAMES = ["GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"]


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def exact_phrases(text: str) -> list[tuple[int, int]]:
    """First and last word of what must stand unedited: the version, if it lies within
    a shingle, and the name of a licence that others resemble."""
    words = _words(text)
    digits = [i for i, w in enumerate(words) if any(c.isdigit() for c in w)]
    out = [(digits[0], digits[-1])] if digits and digits[-1] - digits[0] < WORDS else []
    for name in map(_words, NAMES):
        out += [(i, i + len(name) - 1) for i in range(len(words)) if words[i:i + len(name)] == name]
    return out


def with_shingles(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_h``: the 64-bit hashes of the 5-word shingles in their order."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return (df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
            .withColumn("_h", F.expr(
                f"transform(slice(_w, 1, greatest(size(_w) - {WORDS - 1}, 0)), (x, i) -> xxhash64("
                f"{', '.join(f'_w[i + {k}]' for k in range(WORDS))}))")).drop("_w"))


@dataclass(frozen=True)
class Class:
    """Windows of ``m`` blocks of ``q`` shingles, for templates of least .. most shingles."""

    q: int
    m: int
    least: int
    most: int

    @property
    def bands(self) -> int:
        worst = min(_jaccard(n, self.q * self.m) for n in range(self.least, self.most + 1))
        return 1 if worst >= 1 else math.ceil(math.log(1 - SURE) / math.log(1 - worst))


def _jaccard(n: int, size: int) -> float:
    """Of a template of n shingles, just contained, and a full window."""
    both = -(-n * PERCENT // 100)
    return both / (size + n - both)


def classes(largest: int) -> list[Class]:
    out = [Class(1, 1, 1, 1), Class(1, 2, 2, 2), Class(1, 5, 3, 5)]
    while out[-1].most < largest:
        q = out[-1].q * 2
        out.append(Class(q, 5, out[-1].most + 1, 4 * q + 1))
    return out


def band_constant(band: int) -> int:
    """c_j, a signed 64-bit number, unrelated from band to band."""
    x = (band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    x ^= x >> 31
    return x - (1 << 64) if x >= 1 << 63 else x


def template_rows(templates: DataFrame) -> list[tuple]:
    """(template, license_id, class, its shingles, for each phrase that must stand
    unedited the shingles that hold it); the parameter table, on the driver."""
    rows = with_shingles(templates).select("license_id", "text", "_h").collect()
    if any(not r["_h"] for r in rows):
        raise ValueError(f"a licence template has fewer than {WORDS} words")
    if sum(len(r["_h"]) for r in rows) > MAX_SHINGLES:
        raise ValueError(f"licence templates have more than {MAX_SHINGLES} shingles")
    kinds = classes(max((len(r["_h"]) for r in rows), default=1))
    return [(k, r["license_id"], next(c for c in kinds if len(r["_h"]) <= c.most), list(dict.fromkeys(r["_h"])),
             [[h for i, h in enumerate(r["_h"]) if i <= a and z < i + WORDS] for a, z in exact_phrases(r["text"])])
            for k, r in enumerate(rows)]


def licences(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, license_id, containment, window_start, n_templates)."""
    spark = docs.sparkSession
    rows = template_rows(templates)
    bands = [(c.q, c.m, j, min(x ^ band_constant(j) for x in own), k, name, own, exact)
             for k, name, c, own, exact in rows for j in range(c.bands)]
    minima = sorted({v ^ band_constant(j) for _, _, j, v, *_ in bands})
    index = F.broadcast(spark.createDataFrame(
        bands, "q int, m int, band int, value long, template int, license_id string, own array<long>, exact array<array<long>>"))
    at = "filter(transform(_h, (x, i) -> if({}, i, -1)), i -> i >= 0)".format(
        f"x in ({', '.join(f'{v}L' for v in minima)})" if minima else "false")
    parts = []
    for c in sorted({c for _, _, c, *_ in rows}, key=lambda c: (c.q, c.m)):
        constants = ", ".join(f"{band_constant(j)}L" for j in range(c.bands))
        starts = f"array_distinct(flatten(transform(_at, p -> sequence(greatest(p div {c.q} - {c.m - 1}, 0L), p div {c.q}))))"
        parts.append(
            f"transform({starts}, w -> named_struct('q', {c.q}, 'm', {c.m}, 'start', w * {c.q}, 'sig', "
            f"transform(array({constants}), c -> array_min(transform(slice(_h, cast(w * {c.q} + 1 as int), {c.q * c.m}), x -> x ^ c))), "
            f"'wide', slice(_h, cast(greatest(w * {c.q} - {c.q * c.m // 2}, 0L) + 1 as int), {2 * c.q * c.m})))")
    if not parts:
        return spark.createDataFrame([], "doc_id long, license_id string, containment double, window_start long, n_templates long")
    windows = (with_shingles(docs.select(F.col("doc_id").cast("long"), "text")).drop("text")
               .withColumn("_at", F.expr(at))
               .select("doc_id", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("x")).select("doc_id", "x.*"))
    met = (windows.select("doc_id", "q", "m", "start", "wide", F.posexplode("sig").alias("band", "value"))
           .join(index, ["q", "m", "band", "value"]))
    share = F.size(F.array_intersect("own", "wide"))
    unedited = F.forall("exact", lambda phrase: F.arrays_overlap(phrase, "wide"))
    return (met.withColumn("share", share).where((100 * F.col("share") >= PERCENT * F.size("own")) & unedited)
            .groupBy("doc_id", "license_id")
            .agg(F.max(F.col("share") / F.size("own")).alias("containment"), F.min("start").alias("window_start"),
                 F.count_distinct("template").alias("n_templates")))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, licence whose notice it holds)."""
    return licences(table(spark, sf_dir, "documents"), default_templates(spark))
