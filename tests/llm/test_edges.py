"""Every operator on nulls, empty tables, ties, repeated rows and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from concordia.llm.registry import LLM_QUERIES

CLASHES = ("doc", "tag", "tree", "pos", "path", "start", "width", "whitened", "_doc", "_tag", "_id", "_lost_id", "_lost", "_key", "_lang", "_t", "kept", "quality", "language", "key", "sig", "n", "item",
           "uid", "hash", "length", "html_", "known", "lines", "score", "main_text")
BENCHMARK, LABELS = "item_id long, text string", "doc_id long, quality int, toxic int"
PAGES, DOCUMENTS = "page_id long, url string, html string", "doc_id long, text string, lang string, source string, n_chars long"
OF_PAGES, OF_PAIRS = {"op1_html_extraction"}, {"op3_benchmark_decontamination", "op8_license_scans", "pipeline"}
OF_VECTORS, VECTORS = {"op11_embedding_whitening"}, "vec_id long, embedding array<float>, label int"


def rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60, 120))), ("aa", "bb")[i % 2], "s", 1) for i in range(24)]
    docs += [docs[0], docs[0], (100, None, None, None, None), (101, "", "aa", "s", 0), (102, " \n\t ", "aa", "s", 4),
             (103, "x", None, "s", 1), (None, docs[1][1], "aa", "s", 1), (None, None, None, None, None),
             (104, docs[2][1], None, None, None), (105, "\n".join([docs[3][1]] * 400), "bb", "s", 1),
             (106, "0123456789" * 3000, "bb", "s", 1), (107, "12 34 . é中\U0001f600", "bb", "s", 1)]
    return docs


def table(spark, data, schema):
    df = spark.createDataFrame(data, schema)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES if c not in df.columns))


@pytest.fixture()
def folder(spark, landed):
    docs = rows()
    return landed(
        documents=table(spark, docs, DOCUMENTS),
        benchmark=table(spark, [(1, docs[4][1]), (1, docs[4][1]), (None, "a b c d e f g h"), (2, None), (3, "")], BENCHMARK),
        embeddings=table(spark, [(i, [float(i % 3), float(i % 5)], 1) for i in range(9)] + [(None, None, None)], VECTORS),
        labels=table(spark, [(i, 1, i % 2) for i in range(20)] + [(0, None, None), (None, 1, 1), (3, 0, 1), (3, 0, 0)], LABELS),
        pages=table(spark, [(1, "u", "<p>one two</p>"), (1, "u", "<p>one two</p>"), (None, None, None), (2, None, ""),
                            (3, "u", "<<p"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "a &amp; b &lt; &#x41;")], PAGES))


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_odd_rows(spark, folder, name):
    got = LLM_QUERIES[name](spark, folder).collect()
    if name not in OF_PAGES | OF_PAIRS | OF_VECTORS | {"op2_best_fit_packing"}:
        assert len(got) == len(rows())
    again = [tuple(r) for r in got if r[0] == (1 if name in OF_PAGES else 0)]
    if name in OF_PAGES:
        assert len(got) == 7 and [r["text"] for r in got if r["page_id"] == 5] == ["a & b < A"]
    if name == "op13_merkle_manifest":  # repeated rows are leaves of their own, with the same digest
        assert len(again) == 3 and len({r[1] for r in again}) == 1 and len({r[4] for r in again}) > 1
    elif name not in OF_PAIRS | OF_VECTORS | {"op2_best_fit_packing"}:
        assert len(set(again)) == 1  # repeated rows get the same result


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_empty_tables(spark, landed, name):
    folder = landed(documents=table(spark, [], DOCUMENTS), benchmark=table(spark, [], BENCHMARK),
                    labels=table(spark, [], LABELS), pages=table(spark, [], PAGES), embeddings=table(spark, [], VECTORS))
    assert LLM_QUERIES[name](spark, folder).collect() == []
