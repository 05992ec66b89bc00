"""Licence scans against exact containment of every template in every window."""

import random
import re

import pytest
from pyspark.sql import functions as F

from concordia.llm.licences import SURE, TEMPLATES, Class, classes, default_templates, licences, op8_license_scans


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def whole(texts):
    """(document, licence) whose template stands in a text completely."""
    return {(i, name) for i, t in enumerate(texts) for name, own in TEMPLATES if set(shingles(own)) <= set(shingles(t))}


def found(df):
    return {(r["doc_id"], r["license_id"]) for r in df.collect()}


def filler(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "the", "of"]) for _ in range(n))


def test_whole_templates_anywhere(spark, documents):
    rng = random.Random(1)
    texts = [None, "", "mit", filler(rng, 3000)]
    for at in range(0, 70, 3):
        for name, own in TEMPLATES:
            texts.append(f"{filler(rng, at)}\n{own.upper() if at % 2 else own}\n{filler(rng, rng.randrange(90))}")
    got = found(licences(documents(texts), default_templates(spark)))
    assert got == whole(texts)


def test_edited_notices_are_found_and_less_is_not(spark, documents):
    own = TEMPLATES[2][1].split()
    near, far = list(own), list(own)
    near[20] = "changed"
    for k in range(3, len(far), 6):
        far[k] = "other"
    got = found(licences(documents([" ".join(near), " ".join(far)]), default_templates(spark)))
    assert got == {(0, "MIT")}


def test_versions_and_resembling_names_are_exact(spark, documents):
    texts = ["This work is licensed under the GNU General Public License, version 2.",
             "This work is licensed under the GNU General Public License, version 3.",
             "This work is licensed under the GNU General Public License, version 4.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
             "Public License as published by the Free Software Foundation, either version 3 of the License",
             "This work is licensed under a Creative Commons Attribution 3.0 International License.",
             "Licensed under the Apache License, Version 1.1."]
    assert found(licences(documents(texts), default_templates(spark))) == {(0, "GPL-2.0"), (1, "GPL-3.0"), (3, "AGPL")}


def test_bands_are_enough():
    for c in classes(2000):
        for n in (c.least, c.most):
            both = -(-n * 80 // 100)
            j = both / (c.q * c.m + n - both)
            assert 1 - (1 - j) ** c.bands >= SURE - 1e-9
    assert Class(1, 1, 1, 1).bands == 1


def test_short_template_is_an_error(spark, documents):
    with pytest.raises(ValueError):
        licences(documents(["x"]), spark.createDataFrame([("A", "too short")], "license_id string, text string"))


def test_empty_repeated_and_extra_columns(spark, landed, documents):
    none = spark.createDataFrame([], "license_id string, text string")
    assert licences(documents(["Released under the MIT License."]), none).count() == 0
    assert licences(documents([]), default_templates(spark)).count() == 0
    docs = documents([(7, TEMPLATES[0][1]), (7, TEMPLATES[0][1]), (None, TEMPLATES[0][1])]).withColumn("own", F.lit(1))
    rows = op8_license_scans(spark, landed(documents=docs)).collect()
    assert sorted((r["doc_id"] or -1, r["license_id"], r["containment"]) for r in rows) == [(-1, "MIT", 1.0), (7, "MIT", 1.0)]
    plan = licences(docs, default_templates(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
