"""CSV, snapshot, payload and cache edges; enrichment rules; streaming."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from concordia.operators import enrich as N
from concordia.sources import cache as K
from concordia.sources import csvio, csvsplit
from concordia.sources import payloads as P
from concordia.sources import snapshot as S
from concordia.schema import ENRICHED_COLUMNS


def test_source_csv_bom_quotes_newlines(spark, tmp_path):
    p = tmp_path / "src.csv"
    p.write_bytes('\ufefftitle,artist,duration,extra\n"Song, ""A""","Art\nist",215.5,z\nB,C,,q\n'.encode("utf-8"))
    rows = csvio.read_source_tracks(spark, str(p)).orderBy("position").collect()
    assert [(r.title, r.artist, r.duration, r.isrc, r.key) for r in rows] == [
        ('Song, "A"', "Art\nist", 215.5, "", -1), ("B", "C", 0.0, "", -1)]


def test_bad_number_strict_vs_permissive(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("title,artist,popularity\nA,B,x1\n")
    with pytest.raises(Exception):
        csvio.read_source_tracks(spark, str(p)).collect()
    r = csvio.read_source_tracks(spark, str(p), mode="permissive").first()
    assert r.popularity == 0


def test_export_formats(spark, tmp_path):
    t = N.with_track_defaults(spark.createDataFrame(
        [("A", "B", "u:1", 0.125, 2.675, 0.0, -1, True, 0, 0.0),
         ("C", "D", "", 0.0, 0.0, 0.0, -1, False, 7, 0.5)],
        "title string, artist string, uri string, danceability double, loudness double, duration double, "
        "key int, audio_features_fetched boolean, popularity int, match_confidence double"))
    e = {r.title: r for r in csvio.export_columns(t).collect()}
    a, c = e["A"], e["C"]
    assert list(csvio.export_columns(t).columns) == ENRICHED_COLUMNS
    assert (a.danceability, a.loudness, a.key, a.explicit, a.duration, a.popularity) == ("0.1250", "2.67", "", "false", "", "")
    assert a.audio_features_fetched == "true" and a.tempo == "0.0"
    assert (c.danceability, c.explicit, c.popularity, c.match_confidence) == ("", "", "7", "0.50")


def test_enriched_roundtrip_is_stable(spark, tmp_path):
    t = N.with_track_defaults(spark.createDataFrame(
        [("A", "B", "u:1", 0.12345, 121.04, -5.555, 3, True, 42, 0.875, 215.0, "IS1")],
        "title string, artist string, uri string, danceability double, tempo double, loudness double, key int, "
        "audio_features_fetched boolean, popularity int, match_confidence double, duration double, isrc string"))
    p1, p2 = str(tmp_path / "e1"), str(tmp_path / "e2")
    csvio.write_enriched(t, p1)
    back = csvio.read_enriched(spark, p1)
    csvio.write_enriched(back, p2)
    again = csvio.read_enriched(spark, p2)
    assert back.collect() == again.collect()
    r = back.first()
    assert (r.danceability, r.tempo, r.loudness, r.key, r.match_confidence, r.duration, r.isrc) == \
        (0.1235, 121.0, -5.55, 3, 0.88, 215.0, "IS1")


def test_snapshots_latest_and_absent(spark, tmp_path):
    base = str(tmp_path / "snaps")
    df = spark.createDataFrame([(0, "ytmusic", "a", "T", "A", "", 1.0)],
                               "position long, platform string, track_id string, title string, artist string, "
                               "album string, duration double")
    S.save_snapshot(df, base, "2026-01-01T00-00-00")
    S.save_snapshot(df.withColumn("track_id", F.lit("b")), base, "2026-01-02T00-00-00")
    assert [r.track_id for r in S.load_latest_snapshot(spark, base).collect()] == ["b"]
    h = S.snapshot_history(spark, base).first()
    assert (h.snapshots, h.latest) == (2, "2026-01-02T00-00-00")
    assert S.load_latest_snapshot(spark, str(tmp_path / "none")) is None


def test_playlist_payload_flatten(spark, tmp_path):
    page = {"playlist_id": "p", "page": 0, "tracks": [
        {"title": "S1", "videoId": "v1", "duration": "3:35", "artists": [{"name": "A"}, None, {"id": "x"}],
         "album": {"name": "Al"}},
        None,
        {"title": "S3", "videoId": "", "duration_seconds": "x", "duration": "3:35", "artists": None, "album": None}]}
    p = tmp_path / "pages.json"
    p.write_text(json.dumps(page) + "\n")
    rows = P.flatten_playlist(P.read_playlist_pages(spark, str(p))).orderBy("position").collect()
    assert [(r.position, r.artist, r.album, r.duration, r.url != "") for r in rows] == [
        (0, "A, ", "Al", 215.0, True), (2, "", "", 0.0, False)]


def test_listen_payload_rules(spark, tmp_path):
    docs = [{"lookup_artist": "A", "lookup_title": "T", "track": {"playcount": "12", "listeners": "3",
             "toptags": {"tag": [{"name": "rock"}, {"name": ""}, {}]}}},
            {"lookup_artist": "B", "lookup_title": "T", "error": 6, "message": "not found"},
            {"lookup_artist": "C", "lookup_title": "T", "track": {"playcount": "n/a", "listeners": "1"}},
            {"lookup_artist": "D", "lookup_title": "T", "track": {"listeners": "4"}}]
    p = tmp_path / "listen.json"
    p.write_text("\n".join(json.dumps(d) for d in docs))
    rows = P.parse_listen_payloads(P.read_listen_payloads(spark, str(p))).orderBy("artist").collect()
    assert [(r.artist, r.playcount, r.listeners, r.tags) for r in rows] == [("A", 12, 3, ["rock"]), ("D", 0, 4, [])]


def test_match_cache_and_absent_tables(spark, tmp_path):
    base = str(tmp_path / "mr")
    df = spark.createDataFrame([("f1", True, "u1"), ("f2", False, "")], "fingerprint string, matched boolean, uri string")
    K.write_match_results(df, base, "r1")
    K.write_match_results(spark.createDataFrame([("f1", False, "")], "fingerprint string, matched boolean, uri string"),
                          base, "r2")
    got = {r.fingerprint: (r.matched, r.uri) for r in K.read_match_cache(spark, base).collect()}
    assert got == {"f1": (True, "u1"), "f2": (False, "")}
    assert K.read_match_cache(spark, str(tmp_path / "none")).count() == 0
    assert csvio.read_enriched(spark, str(tmp_path / "none")).count() == 0


def test_apply_match_rules(spark):
    tracks = N.with_track_defaults(spark.createDataFrame(
        [(1, "", "2025-01-01T00:00:00"), (2, "OLD", ""), (3, "", "")],
        "position long, isrc string, first_synced string"))
    m = spark.createDataFrame([(1, "u1", "NEW1", "isrc", 1.0), (2, "u2", "NEW2", "relaxed", 0.5),
                               (3, "", "", "", 0.0)],
                              "position long, uri string, isrc string, method string, confidence double")
    r = {x.position: x for x in N.apply_match(tracks, m, "position", "TS").collect()}
    assert (r[1].isrc, r[1].first_synced, r[1].last_synced, r[1].match_method) == ("NEW1", "2025-01-01T00:00:00", "TS", "isrc")
    assert (r[2].isrc, r[2].first_synced) == ("OLD", "TS")
    assert (r[3].uri, r[3].last_synced) == ("", "")


def test_audio_features_flag_all_attempted(spark):
    tracks = N.with_track_defaults(spark.createDataFrame([(1, "x:c1"), (2, "x:c2"), (3, "")],
                                                         "position long, uri string"))
    feats = spark.createDataFrame([("c1", 0.0, 120.0)], "catalog_id string, danceability double, tempo double")
    from concordia.schema import AUDIO_FEATURES
    for f in AUDIO_FEATURES:
        if f not in feats.columns:
            feats = feats.withColumn(f, F.lit(None).cast("double"))
    r = {x.position: x for x in N.audio_features(tracks, feats).collect()}
    assert (r[1].audio_features_fetched, r[1].tempo, r[1].key) == (True, 120.0, -1)
    assert (r[2].audio_features_fetched, r[2].tempo, r[2].mode) == (True, 0.0, -1)
    assert r[3].audio_features_fetched is False


ROW = "fingerprint string, position long, title string"


def test_stream_keeps_what_arrived_last_and_compacts(spark, tmp_path):
    """A later arrival wins over a greater position; reading cost is bounded by the
    deltas since the last compaction; a repeated run applies nothing."""
    from concordia.streaming import incremental as T9
    landing, state, ckpt = (str(tmp_path / x) for x in ("land", "state", "ckpt"))
    want = {}
    for k in range(7):
        rows = [(f"f{i}", 100 - 10 * k + i, f"t{k}") for i in range(k % 3, 5)] + [("twice", 7, "low"), ("twice", 9, f"high{k}")]
        want.update({f: (p, t) for f, p, t in rows})
        df = spark.createDataFrame(rows, ROW)
        T9.land(df, landing)
        assert T9.run_incremental(spark, landing, df.schema, state, ckpt, compact_every=3) == 1
        table = T9.state_tables(spark, state)["state"]
        assert len(table.pending()) < 3
        assert {r.fingerprint: (r.position, r.title) for r in T9.read_state(spark, state).collect()} == want
    assert T9.run_incremental(spark, landing, df.schema, state, ckpt) == 0
    assert len(table.base.commits()) == 2


def test_a_batch_delivered_again_after_it_was_folded_changes_nothing(spark, tmp_path):
    from concordia.streaming.incremental import StateTable
    table = StateTable(spark, str(tmp_path), "state", "fingerprint", "position")
    for k in range(3):
        table.write(spark.createDataFrame([("a", 9 - k, f"t{k}")], ROW), k)
    table.compact()
    table.write(spark.createDataFrame([("a", 8, "t1")], ROW), 1)
    assert [r.title for r in table.read().collect()] == ["t2"] and table.pending() == []
    table.compact()
    table.write(spark.createDataFrame([("a", 1, "t3"), ("b", 1, "x")], ROW), 3)
    assert sorted(r.title for r in table.read().collect()) == ["t3", "x"]


@pytest.mark.parametrize("split", ["4000", "9k", "1m"])
def test_large_csv_is_read_in_splits_like_in_one_piece(spark, tmp_path, split):
    """Quoted newlines, BOM, \\r\\n, long runs of lines in a field: rows and
    positions do not depend on where files are split."""
    rng, rows = random.Random(1), []
    for f in range(3):
        with open(tmp_path / f"part-{f}.csv", "w", newline="", encoding="utf-8-sig" if f == 1 else "utf-8") as out:
            w = csv.writer(out, lineterminator="\r\n" if f == 2 else "\n")
            w.writerow(["title", "artist", "n"] if f else ["artist", "title", "n"])
            for i in range(500):
                title = "".join(rng.choice('ab ,"\né中') for _ in range(rng.randrange(1, 40)))
                artist = rng.choice(["x", 'multi\n\n\nline, "q"\n', "", '"', "\n" * rng.randrange(1, 30) + "z"])
                w.writerow([title, artist, f"{f}-{i}"] if f else [artist, title, f"{f}-{i}"])
                rows.append((title, artist, f"{f}-{i}"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = csvsplit.read_csv_records(spark, str(tmp_path)).orderBy("position").collect()
        as_strings = csvio.read_csv_strings(spark, str(tmp_path)).count() if split != "1m" else len(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r.title or "", r.artist or "", r.n) for r in got] == rows and as_strings == len(rows)
    assert [r.position for r in got] == [f * csvsplit.POSITIONS + i for f in range(3) for i in range(500)]


def test_lookup_tables_with_repeated_keys_multiply_no_track(spark):
    tracks = N.with_track_defaults(spark.createDataFrame(
        [(1, "x:c1", "T", "A"), (2, "x:c2", "U", "B")], "position long, uri string, title string, artist string"))
    catalog = spark.createDataFrame(
        [("c1", 1, False, 2, 3, "d", "album", "i", "a1"), ("c1", 1, False, 5, 3, "d", "album", "i", "a1")],
        "catalog_id string, duration_ms long, explicit boolean, popularity int, track_number int, release_date string, "
        "album_type string, isrc string, artist_id string")
    artists = spark.createDataFrame([("a1", ["x"]), ("a1", ["x"])], "artist_id string, genres array<string>")
    stats = spark.createDataFrame([("A", "T", 5, 1, ["r"]), ("A", "T", 5, 1, ["r"])],
                                  "artist string, title string, playcount long, listeners long, tags array<string>")
    got = N.listen_stats(N.backfill_genres(N.backfill_metadata(tracks, catalog), catalog, artists), stats)
    assert sorted((r.position, r.popularity, r.artist_genres, r.playcount) for r in got.collect()) == [
        (1, 5, "x", 5), (2, 0, "", 0)]


def test_a_repeated_run_replaces_its_own_partition(spark, tmp_path):
    from concordia.sources import snapshot
    df = spark.createDataFrame([(1, "p", "a", "t", "x", "y", 1.0)],
                               "position long, platform string, track_id string, title string, artist string, "
                               "album string, duration double")
    base = f"{tmp_path}/snapshots"
    for ts in ("2026-01-01", "2026-01-02", "2026-01-01"):
        snapshot.save_snapshot(df, base, ts)
    assert spark.read.parquet(base).count() == 2
