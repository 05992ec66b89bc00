"""The manifest against a plain construction of the same trees."""

import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from concordia.llm import merkle
from concordia.llm.merkle import op13_merkle_manifest

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, arity):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        out.append(nodes)
    return out


def steps(tree, pos, arity):
    for level in tree[:-1]:
        first = pos // arity * arity
        yield level[first:pos], level[pos + 1:first + arity]
        pos //= arity


def brute(rows, arity=2):
    """rows of (doc_id, text, lang, source, n_chars)"""
    leaf = lambda d, t, l, s, n: H(*map(framed, (d, s, l, n, t)))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda x: x[:3])
        trees[name] = levels([x[2] for x in langs[name]], arity)
    top = levels([trees[n][-1][0] for n in names], arity)
    out = []
    for k, name in enumerate(names):
        for pos, (*_, digest, r) in enumerate(langs[name]):
            path = [*steps(trees[name], pos, arity), *steps(top, k, arity)]
            proof = H(*(x for left, right in path for x in (*left, *right)))
            chosen = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(*r[:4], r[4] + 1) if chosen else digest
            for left, right in path:
                node = H(*left, node, *right)
            out.append((r[0], digest, trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_of_a_table_equals_brute_force_and_sql(spark):
    rows = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet'").fetchall()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = collected(op13_merkle_manifest(spark, SF))
    assert got == brute(rows) == sorted(con.sql(merkle.SQL).fetchall(), key=str)
    assert {r[-1] for r in got} == {True, False}


ODD = [(5, "five", "en", "s", 4), (None, None, None, None, None), (7, "", "é", None, 0), (7, "", "é", None, 0), (1, "x", "zz", "s", 2**63 - 1),
       *((i, f"text {i} 中", "en", None if i % 3 else "src", None if i % 5 == 0 else i) for i in range(10, 33)), (4, "lone", "fr", "s", 4)]


def test_odd_rows(spark, landed):
    df = spark.createDataFrame(ODD, SCHEMA)
    df = df.select("*", *(F.lit("x").alias(c) for c in ("tree", "pos", "m", "block", "leaf", "path", "root", "digest")))
    assert collected(op13_merkle_manifest(spark, landed(documents=df))) == brute(ODD)


@pytest.mark.parametrize("arity,segment", [(2, 1), (2, 3), (3, 2), (4, 1)])
def test_trees_of_many_rounds_and_other_arities(spark, scratch, arity, segment):
    paths = merkle.proofs(spark.createDataFrame(ODD, SCHEMA), scratch, arity, segment)
    got = collected(paths.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256),
                                 merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))))
    assert got == [r[:-1] for r in brute(ODD, arity)]


def test_one_row_and_none(spark, landed, scratch):
    one = [(3, "t", "en", "s", 1)]
    got = collected(op13_merkle_manifest(spark, landed(documents=spark.createDataFrame(one, SCHEMA))))
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha256(b"").hexdigest()
    assert merkle.proofs(spark.createDataFrame([], SCHEMA), scratch).collect() == []


def test_a_manifest_that_does_not_lead_to_its_leaf_is_refused():
    node, path = merkle.descend({"r": ["a", "b"], "b": ["c"]}, "r", 2, 2, 2)
    assert (node, path) == ("c", ["", "", "a", ""])
