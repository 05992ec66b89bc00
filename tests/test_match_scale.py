"""The resolver's work is dealt over tasks, done once, and a product of rows is never written."""

import pytest
from pyspark.sql import functions as F

from concordia.config import MatchConfig
from concordia.operators import candidates, classes, match
from concordia.operators.match import match_single_pass, prepare_catalog, prepare_source, score_candidates

CATALOG = "catalog_id string, uri string, isrc string, duration_ms int, popularity int, name string, artist string"


@pytest.fixture
def written(monkeypatch):
    """Rows of every intermediate table that the resolver writes, by its name."""
    rows = {}
    real = match.cut_lineage

    def cut(df, name="stage", path=None):
        out = real(df, name, path)
        rows[name] = rows.get(name, 0) + out.count()
        return out
    for module in (match, candidates):
        monkeypatch.setattr(module, "cut_lineage", cut)
    return rows


def _tables(spark):
    catalog = spark.createDataFrame(
        [(f"c{i}", f"u{i:02}", "", 1000 * (10 + i), i % 7, "Blue Moon", "Some One") for i in range(60)]
        + [("other", "x", "", 5000, 1, "Red Sun", "Some One")], CATALOG)
    source = spark.createDataFrame([(i, "blue moon", "some one, guest" if i % 2 else "some one", float(i)) for i in range(80)],
                                   "position long, title string, artist string, duration double")
    return source, catalog


@pytest.mark.parametrize("cell, task_rows", [(2048, 2_000_000), (7, 100)])
@pytest.mark.parametrize("metric", ["ratio", "levenshtein"])
def test_scored_rows_are_neither_written_nor_missed(spark, written, monkeypatch, cell, task_rows, metric):
    monkeypatch.setattr(match, "CELL", cell)
    monkeypatch.setattr(match, "TASK_ROWS", task_rows)
    source, catalog = _tables(spark)
    got = score_candidates(prepare_source(source, "position"), prepare_catalog(catalog), MatchConfig(metric=metric), True).collect()
    assert len(got) == 80 * 60 and len({(r.s_artist, r.s_duration, r.uri) for r in got}) == 80 * 60
    assert max(written.values()) <= 160
    ranked = sorted(range(60), key=lambda i: (-(i % 7), f"u{i:02}"))
    sims = {"some one": 1.0, "some one, guest": 16 / 23 if metric == "ratio" else 1 - 7 / 15}
    for r in got:
        close = r.s_duration <= 0 or abs(r.s_duration - r.duration_ms / 1000) <= 5
        score = 0.45 + 0.40 * sims[r.s_artist] + 0.15 * (1.0 if close else 0.5)
        assert r.score == pytest.approx(score) and r.eff == pytest.approx(min(score + 0.1 * close, 1.0))
        assert r.uri == f"u{ranked[r['rank'] - 1]:02}"


def test_rows_alike_in_their_keys_meet_a_query_once(spark, written):
    source, catalog = _tables(spark)
    got, _, _ = match.search_candidates(prepare_source(source, "position"), prepare_catalog(catalog), MatchConfig(), True)
    assert got.count() == 60 and written["query-key-sets"] == 1


def test_no_pairs_give_no_rows(spark):
    source, catalog = _tables(spark)
    nothing = source.withColumn("title", F.lit("unheard"))
    assert score_candidates(prepare_source(nothing, "position"), prepare_catalog(catalog), MatchConfig(), True).count() == 0


def test_one_file_is_normalised_by_many_tasks(spark):
    source, catalog = (df.coalesce(1) for df in _tables(spark))
    assert prepare_source(source, "position").rdd.getNumPartitions() >= 4
    assert prepare_catalog(catalog).rdd.getNumPartitions() >= 4


def test_a_single_pass_normalises_both_sides_once(spark, written):
    source, catalog = _tables(spark)
    assert match_single_pass(source, catalog, "title_artist").count() == 80
    assert (written["prepared"], written["catalog-index"]) == (80, 61)


def test_pairs_of_one_small_file_are_bounded_by_many_tasks(spark, monkeypatch):
    """The pairs of a few classes and many probes: next to no bytes, but work for all tasks."""
    tasks = {}
    real = classes.cut_lineage

    def cut(df, name="stage", path=None):
        out = real(df.withColumn("_task", F.spark_partition_id()), name, path)
        tasks[name] = out.select("_task").distinct().count()
        return out.drop("_task")
    monkeypatch.setattr(classes, "cut_lineage", cut)
    source, catalog = (df.coalesce(1) for df in _tables(spark))
    assert match_single_pass(source, catalog, "title_artist").count() == 80
    assert tasks["probe-classes"] >= 4


def test_character_counts(spark):
    texts = ["", "blue moon", "a\nb\x00", "żółw 日\U0001f600x", "$1\\0", None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", classes.char_counts(F.col("s")).alias("n")).collect()
    for r in got:
        want = [None] * 16 if r.s is None else [sum(ord(c) % 16 == k for c in r.s) for k in range(16)]
        assert r.n == want
