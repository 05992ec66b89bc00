"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from concordia import oracle
from concordia.sources.tables import TABLES

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def _norm(v):
    if v is None:
        return "\x00"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def _connected(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _compare(spark, con, sf_dir, name, sql):
    df = E.queries()[name](spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want_cols, want = list(rel.columns), rel.fetchall()
    assert sorted(got_cols) == sorted(want_cols)
    assert _rows(got_cols, got) == _rows(want_cols, want)


@pytest.fixture(scope="module")
def con():
    oracle.ORACLE_SF_DIR = SF001
    yield _connected(SF001)
    oracle.ORACLE_SF_DIR = SF01


@pytest.mark.parametrize("name", sorted(E.REGISTRY))
def test_query_matches_oracle(spark, con, name):
    _compare(spark, con, SF001, name, E.oracle_sql()[name])


@pytest.mark.parametrize("name", ["q_match_relaxed", "q_match_waterfall"])
def test_resolver_matches_oracle_where_queries_are_crowded(spark, name):
    """At sf0.01 a query has up to 46 containing rows, more than any search depth."""
    oracle.ORACLE_SF_DIR = SF01
    _compare(spark, _connected(SF01), SF01, name, E.ORACLE[name]())
