"""Resolver: fixture counts, hot-key path equivalence, brute force, properties."""

import re

import pytest
from pyspark.sql import functions as F

from concordia.config import MatchConfig
from concordia.operators import classes
from concordia.operators.match import (build_postings, match_fuzzy, match_waterfall, prepare_catalog, prepare_source,
                                       score_candidates, search_candidates)
from concordia.operators.ranges import band_join
from concordia.sources import fixtures as fx

SF001 = "/root/testdata/sf0.001"


def _counts(df):
    return {r["method"] or "none": r["count"] for r in df.groupBy("method").count().collect()}


@pytest.fixture(scope="module")
def waterfall(spark):
    return match_waterfall(fx.source(spark, SF001), fx.catalog(spark, SF001), MatchConfig()).cache()


def test_waterfall_counts(waterfall):
    assert _counts(waterfall) == {"isrc": 67, "title_artist": 86, "relaxed": 14, "none": 33}


def test_one_row_per_source_row(waterfall):
    assert waterfall.count() == waterfall.select("position").distinct().count() == 200


def test_raising_threshold_never_adds_matches(spark, waterfall):
    strict = match_waterfall(fx.source(spark, SF001), fx.catalog(spark, SF001), MatchConfig(pass3_threshold=0.6))
    c = _counts(strict)
    assert c["relaxed"] == 8 and c["none"] == 39
    loose_ids = {r.position for r in waterfall.where("matched").select("position").collect()}
    strict_ids = {r.position for r in strict.where("matched").select("position").collect()}
    assert strict_ids <= loose_ids


def test_confidence_bounds(waterfall):
    isrc = waterfall.where(F.col("method") == "isrc").agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.95 <= isrc[0] <= isrc[1] <= 1.0
    ta = waterfall.where(F.col("method") == "title_artist").agg(F.min("confidence")).first()[0]
    assert ta >= 0.5


def _cands(spark, cfg, with_artist=True):
    prepared = prepare_source(fx.source(spark, SF001), "position")
    index = prepare_catalog(fx.catalog(spark, SF001))
    c, _, q = search_candidates(prepared, index, cfg, with_artist)
    return sorted(tuple(r) for r in c.select(*q, "uri", "rank").collect())


def _brute(spark, with_artist):
    """All-pairs reference on the small fixture (test oracle only)."""
    prepared = prepare_source(fx.source(spark, SF001), "position").collect()
    index = prepare_catalog(fx.catalog(spark, SF001)).collect()
    tok = lambda s: set(re.findall(r"[a-z0-9]+", s))
    ranked = sorted(index, key=lambda r: (-r.popularity, r.uri))
    out = set()
    for q in {(p.s_title, p.s_first_artist) for p in prepared}:
        t, a = q
        if with_artist:
            if not (t or a) or not (tok(t) | tok(a)):
                continue
            hits = [c for c in ranked if tok(t) <= tok(c.c_name) and tok(a) <= tok(c.c_artist)]
            out |= {(t, a, c.uri, i + 1) for i, c in enumerate(hits)}
        else:
            if not t or not tok(t):
                continue
            hits = [c for c in ranked if tok(t) <= tok(c.c_name)]
            out |= {(t, c.uri, i + 1) for i, c in enumerate(hits)}
    return sorted(out)


@pytest.mark.parametrize("with_artist", [True, False])
def test_candidates_equal_brute_force(spark, with_artist):
    assert _cands(spark, MatchConfig(), with_artist) == _brute(spark, with_artist)


@pytest.mark.parametrize("with_artist", [True, False])
def test_hot_key_pairs_and_salting_are_exact(spark, with_artist):
    """Tiny limits force every key hot (pair blocks) and every block salted."""
    cfg = MatchConfig(hot_block_rows=5, rows_per_task=3)
    assert _cands(spark, cfg, with_artist) == _brute(spark, with_artist)


def test_levenshtein_metric_runs(spark):
    r = match_waterfall(fx.source(spark, SF001), fx.catalog(spark, SF001), MatchConfig(metric="levenshtein"))
    c = _counts(r)
    assert c["isrc"] == 67 and sum(c.values()) == 200


def test_hot_source_group_resolves_every_row(spark):
    """A third of the source rows share one title/artist: every row still
    gets exactly one result (nothing dropped, nothing duplicated)."""
    src = fx.source(spark, SF001)
    hot = src.where(F.col("position") % 3 == 0).select(
        "position", "platform", "track_id", F.lit("cold widget").alias("title"), F.lit("Brand#13").alias("artist"),
        "album", F.lit("").alias("isrc"), "duration")
    rest = src.where(F.col("position") % 3 != 0)
    r = match_waterfall(hot.unionByName(rest), fx.catalog(spark, SF001), MatchConfig())
    assert r.count() == 200 and r.select("position").distinct().count() == 200
    hot_methods = {x.method for x in r.where(F.col("position") % 3 == 0).select("method").distinct().collect()}
    assert hot_methods <= {"title_artist", "relaxed", ""}


def test_prebuilt_catalog_index_gives_same_results(spark, waterfall, tmp_path):
    from concordia.operators.match import build_catalog_index
    ci = build_catalog_index(fx.catalog(spark, SF001), MatchConfig(), base=str(tmp_path / "idx"))
    r = match_waterfall(fx.source(spark, SF001), ci, MatchConfig())
    cols = ["position", "uri", "method", "confidence"]
    assert sorted(tuple(x) for x in r.select(*cols).collect()) == \
        sorted(tuple(x) for x in waterfall.select(*cols).collect())


@pytest.mark.parametrize("built_with, asked_with", [(5, 1_000_000), (1_000_000, 5), (5, 40)])
def test_an_index_built_with_other_knobs_gives_the_same_candidates(spark, built_with, asked_with):
    prepared = prepare_source(fx.source(spark, SF001), "position")
    index = prepare_catalog(fx.catalog(spark, SF001))
    built = build_postings(index, MatchConfig(hot_block_rows=built_with))
    c, _, q = search_candidates(prepared, index, MatchConfig(hot_block_rows=asked_with, rows_per_task=7), True, built)
    assert sorted(tuple(r) for r in c.select(*q, "uri", "rank").collect()) == _brute(spark, True)


def test_the_least_popular_row_can_win(spark):
    rows = [(f"c{i:02d}", f"u:{i:02d}", "blue river " + "long tail words " * (i < 49), 100 - i) for i in range(50)]
    base = fx.catalog(spark, SF001)
    one = base.limit(1)
    names = spark.createDataFrame(rows, "_id string, _uri string, _name string, _pop int")
    catalog = (one.crossJoin(names).withColumns({
        "catalog_id": F.col("_id"), "uri": F.col("_uri"), "name": F.col("_name"), "artist": F.lit("Band"),
        "popularity": F.col("_pop"), "isrc": F.lit("")}).select(*base.columns))
    src = fx.source(spark, SF001)
    source = src.limit(1).withColumns({"title": F.lit("Blue River"), "artist": F.lit("Band"), "isrc": F.lit("")}).select(*src.columns)
    assert [r["uri"] for r in match_waterfall(source, catalog, MatchConfig()).collect()] == ["u:49"]


def test_best_of_many_containing_rows_may_be_the_least_popular(spark):
    catalog = spark.createDataFrame(
        [(f"c{i}", f"u{i:02}", "", 200000, 100 - i, "blue moon " + "x" * (60 - i), "someone") for i in range(49)]
        + [("c49", "u49", "", 200000, 1, "blue moon", "someone")],
        "catalog_id string, uri string, isrc string, duration_ms int, popularity int, name string, artist string")
    source = spark.createDataFrame([(1, "Blue Moon", "someone", 200.0)], "position long, title string, artist string, duration double")
    assert [r.uri for r in match_waterfall(source, catalog).collect()] == ["u49"]


def _best_of_all(prepared, index, with_artist):
    """The arg-max over every scored candidate row, as plain Python."""
    score, threshold = ("eff", 0.5) if with_artist else ("score", 0.4)
    best = {}
    for r in score_candidates(prepared, index, MatchConfig(), with_artist).collect():
        probe = (r.s_title, r.s_first_artist, r.s_artist, r.s_duration)
        best[probe] = max(best.get(probe, (-1.0, 0, "")), (r[score], -r["rank"], r.uri))
    return {p: (u, s) for p, (s, _, u) in best.items() if s >= threshold and u}


def _argmax(prepared, index, with_artist, cfg, work=None):
    hits = match_fuzzy(prepared, index, cfg, with_artist, work=work).join(prepared, "_id").collect()
    return {(r.s_title, r.s_first_artist, r.s_artist, r.s_duration): (r.uri, r.confidence) for r in hits}


@pytest.mark.parametrize("with_artist", [True, False])
def test_bounded_rounds_find_the_same_best(spark, monkeypatch, with_artist):
    monkeypatch.setattr(classes, "VISITED", (1, 2, None))
    prepared = prepare_source(fx.source(spark, SF001), "position")
    index = prepare_catalog(fx.catalog(spark, SF001))
    work = {}
    got = _argmax(prepared, index, with_artist, MatchConfig(pairs_at_once=0, hot_block_rows=5, rows_per_task=3), work)
    assert got == _best_of_all(prepared, index, with_artist) and work["scored"] <= work["pairs"]


def test_rows_of_one_name_cost_one_pair(spark):
    """2,000 rows of one name and artist in many durations: a pair a probe, the
    result that of all rows."""
    rows = [(f"c{i}", f"u{i:04}", "", 1000 * (i % 400), i % 7, "Blue Moon", "Someone") for i in range(2000)]
    catalog = spark.createDataFrame(rows, "catalog_id string, uri string, isrc string, duration_ms int, popularity int, name string, artist string")
    source = spark.createDataFrame([(i, "blue moon", "someone", d) for i, d in enumerate([0.0, 3.0, 5.5, 200.0, 404.0, 404.5, 9000.0])],
                                   "position long, title string, artist string, duration double")
    prepared, index, work = prepare_source(source, "position"), prepare_catalog(catalog), {}
    got = _argmax(prepared, index, False, MatchConfig(), work)
    assert got == _best_of_all(prepared, index, False) and len(got) == 7 and work["pairs"] == 7


@pytest.mark.parametrize("tolerance", [0.0, 0.1, 5.0, 7.3])
def test_band_join_equals_all_pairs(spark, tolerance):
    a = [(i % 3, i, round(i * 0.7, 1)) for i in range(60)] + [(0, 99, None), (1, 98, -3.0)]
    b = [(i % 3, i, round(i * 0.5 - 4, 1)) for i in range(90)] + [(0, 99, None)]
    left = spark.createDataFrame(a, "g int, i int, x double")
    right = spark.createDataFrame(b, "g int, j int, y double")
    got = sorted((r.i, r.j) for r in band_join(left, right, ["g"], "x", "y", tolerance).collect())
    assert got == sorted((i, j) for g, i, x in a for h, j, y in b if g == h and None not in (x, y) and abs(x - y) <= tolerance)
