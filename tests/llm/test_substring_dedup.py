"""Substring dedup against a plain search of all windows."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from concordia.llm import substring_dedup
from concordia.llm.substring_dedup import LENGTH, SubstringDedup, op12_substring_dedup

SF = "/root/testdata/sf0.01"


def brute(rows):
    """{row: (n_words, n_removed, kept)} by a dictionary of all windows."""
    first, words = {}, {}
    for k, (doc, text) in enumerate(rows):
        words[k] = (text or "").encode().split()
        if doc is not None:
            for s in range(len(words[k]) - LENGTH + 1):
                w = tuple(words[k][s:s + LENGTH])
                first[w] = min(first.get(w, (doc, s)), (doc, s))
    out = []
    for k, (doc, _) in enumerate(rows):
        gone = set()
        if doc is not None:
            for s in range(len(words[k]) - LENGTH + 1):
                if first[tuple(words[k][s:s + LENGTH])] < (doc, s):
                    gone |= set(range(s, s + LENGTH))
        kept = b" ".join(w for i, w in enumerate(words[k]) if i not in gone)
        out.append((doc, len(words[k]), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, folder):
    return sorted((tuple(r) for r in op12_substring_dedup(spark, folder).collect()), key=str)


def documents_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def test_all_of_a_table_equals_brute_force_and_sql(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = result(spark, SF)
    assert got == brute(rows) == sorted(con.sql(substring_dedup.SQL).fetchall(), key=str)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("seed", range(3))
def test_edited_copies_edges_and_low_entropy(spark, landed, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(60):
        a = rng.randrange(0, 50)
        own = passage[a:a + rng.randrange(15, 45)]
        if rng.random() < 0.5:
            own[rng.randrange(len(own))] = "edit"
        rows.append((rng.randrange(1000), " ".join(["x%d" % i] * rng.randrange(3) + own + [rng.choice(vocabulary) for _ in range(8)])))
    rows = list({d: (d, t) for d, t in rows}.values())
    rows += [(2000, "la " * 90), (2001, "la " * 30 + "di " * 30), (2002, " ".join(passage[:19])), (2003, " ".join(passage[:20])),
             (2004, "\t\n".join(passage)), (2005, "a b " * 40), (2006, " ".join(passage) + " " + " ".join(passage))]
    assert result(spark, landed(documents=documents_of(spark, rows))) == brute(rows)


def test_a_passage_in_every_document_goes_from_all_but_one(spark, landed):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"before{i} one{i} {passage} after{i}") for i in range(300)]
    got = {r[0]: r[2] for r in result(spark, landed(documents=documents_of(spark, rows)))}
    assert got == {i: 25 if i else 0 for i in range(300)}


def test_repeated_ids_and_null_ids(spark, landed, scratch):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(5, a), (5, a), (5, "x " + a), (5, b), (None, b), (7, b), (7, None), (8, ""), (None, None)]
    got = result(spark, landed(documents=documents_of(spark, rows)))
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] is None] == [0, 0]


def test_maximal_repeats_and_other_columns(spark, scratch):
    a = " ".join(f"a{i}" for i in range(50))
    docs = documents_of(spark, [(1, a), (2, "q r " + a + " s"), (3, "short")]).withColumn("kept_", F.lit(1)).withColumn("doc", F.lit("clash"))
    rows = {r.doc_id: r for r in SubstringDedup(docs.select("doc_id", "text", "kept_", "doc"), scratch).result().collect()}
    assert [(s.start, s.end) for s in rows[2].kept.removed] == [(2, 52)] and rows[2].kept.text == "q r s"
    assert rows[1].kept.removed == [] and rows[3].kept.text == "short" and rows[2].doc == "clash"
