"""Whitening against an eigendecomposition of the covariance, in exact centring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.llm import whitening
from concordia.llm.whitening import op11_embedding_whitening

SF = "/root/testdata/sf0.01"


def brute(vectors, count=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(object) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = x * n - sums
    a = (y / n).astype(np.float64)
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    return (y ** 2).sum(axis=1), e, (a @ v[:, :count]) / np.sqrt(e[:count])


def frame(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], schema)


def compare(got, ids, vectors, count):
    deviation, e, white = brute(vectors, count)
    for k in range(count):
        own = {r.vec_id: r for r in got if r.component == k + 1}
        mine = np.array([own[i].whitened for i in ids])
        assert np.allclose(mine * np.sign(mine @ white[:, k]), white[:, k], atol=1e-6)
        assert own[ids[0]].explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
    assert [own[i].deviation for i in ids] == deviation.tolist()
    assert max(r.identity_error for r in got) < 1e-9 and {r.n for r in got} == {len(ids)}


def test_all_of_a_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = op11_embedding_whitening(spark, SF).collect()
    assert len(got) == 32 * len(rows)
    compare(got, [r.vec_id for r in rows], [list(r.embedding) for r in rows], 32)


def test_holes_lengths_and_constants(spark, landed):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=4)] + [2.0]) for i in range(50)]
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 2.0]), (103, [1.0, float("nan"), 1.0, 1.0, 2.0]),
           (104, [1.0, 1.0, float("inf"), 1.0, 2.0]), (105, [1.0, 2.0]), (106, [1e30, 1.0, 1.0, 1.0, 2.0])]
    got = op11_embedding_whitening(spark, landed(embeddings=frame(spark, good + bad))).collect()
    assert {r.vec_id for r in got} == {i for i, _ in good} and {r.component for r in got} == {1, 2, 3, 4}
    compare(got, [i for i, _ in good], [v[:4] for _, v in good], 4)


def test_variances_that_lie_far_apart(spark, landed):
    """Singular values from 1e9 to 1: the covariance alone could not tell the least from noise."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=4) * [1e9, 1e6, 1e3, 1.0]]) for i in range(400)]
    folder = landed(embeddings=frame(spark, rows, "vec_id long, embedding array<double>, label int"))
    got = op11_embedding_whitening(spark, folder).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and max(r.identity_error for r in got) < 1e-6
    last = [r.explained for r in got if r.component == 4][0]
    assert last == pytest.approx(1e-18, rel=0.5)


def test_mixtures_of_others_are_no_components(spark, landed):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b), float(a + b), float(a - b)]) for i, (a, b) in enumerate(rng.integers(-9, 9, (80, 2)))]
    got = op11_embedding_whitening(spark, landed(embeddings=frame(spark, rows))).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_that_varies(spark, landed, rows):
    assert op11_embedding_whitening(spark, landed(embeddings=frame(spark, rows))).collect() == []


def test_repeated_rows_null_ids_and_clashing_columns(spark, landed):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [3.0, 1.0]), (2, [1.0, 5.0])]
    df = frame(spark, rows).select("*", *(F.lit("x").alias(c) for c in ("width", "count", "cell", "value", "n", "pos", "whitened")))
    got = op11_embedding_whitening(spark, landed(embeddings=df)).collect()
    assert len(got) == 8 and {r.n for r in got} == {4}
    assert len({(r.component, r.whitened) for r in got if r.vec_id == 1}) == 2


def test_large_deviations_are_exact_or_null():
    m = whitening.Moments(3, (3 << 40, 0))
    x = np.array([[1 << 40, 1 << 40], [1 << 40, 2]])
    assert m.deviation(x) == [None, 36]
