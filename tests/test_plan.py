"""Diff, sync-plan operators and change sets."""

import os

import pytest
from pyspark.sql import functions as F

from concordia.operators import changes as C
from concordia.operators.diff import diff_counts, diff_snapshots
from concordia.operators.keys import dedupe_last_wins, global_row_number
from concordia.sources import fixtures as fx

SF001 = "/root/testdata/sf0.001"


def test_diff_counts_and_partition(spark):
    cur, prev = fx.current(spark, SF001), fx.previous(spark, SF001)
    d = diff_snapshots(cur, prev, cols=["position", "title"]).cache()
    c = diff_counts(d).first()
    assert (c.added, c.removed, c.unchanged) == (20, 20, 160)
    assert c.summary == "+20 added, -20 removed, 160 unchanged" and c.has_changes
    cur_keys = {r[0] for r in cur.select("fingerprint").distinct().collect()}
    kept = {r[0] for r in d.where(F.col("change_type") != "removed").select("fingerprint").collect()}
    removed = {r[0] for r in d.where(F.col("change_type") == "removed").select("fingerprint").collect()}
    assert kept == cur_keys and not (removed & cur_keys)


def test_first_run_keeps_duplicates(spark):
    cur = fx.current(spark, SF001)
    d = diff_snapshots(cur, None, cols=["position"])
    assert d.count() == cur.count() == 184


def test_last_wins(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("k", 3, "c"), ("j", 2, "d")],
                               "fingerprint string, position long, title string")
    got = sorted(tuple(r) for r in dedupe_last_wins(df, "fingerprint").collect())
    assert got == [("j", 2, "d"), ("k", 5, "b")]


def test_global_row_number_dense(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("v"))
    r = global_row_number(df, ["v"], "n", num_partitions=5).collect()
    assert sorted(x.n for x in r) == list(range(1, 1001))
    assert all(x.n == x.v + 1 for x in r)


def test_limit_pending(spark):
    df = spark.createDataFrame([(p, f"f{p}") for p in [9, 3, 7, 1, 5]], "position long, fingerprint string")
    got = {r.position: r.state for r in C.limit_pending(df, 2).collect()}
    assert got == {1: "search", 3: "search", 5: "pending", 7: "pending", 9: "pending"}


def test_to_remove_keeps_still_wanted_uris(spark):
    removed = spark.createDataFrame([("a",), ("b",)], "fingerprint string")
    existing = spark.createDataFrame([("a", 1, "u1"), ("b", 2, "u2"), ("c", 3, "u2")],
                                     "fingerprint string, position long, uri string")
    wanted = spark.createDataFrame([("u2",)], "uri string")
    assert [r.uri for r in C.to_remove(removed, existing, wanted).collect()] == ["u1"]
    strict = sorted(r.uri for r in C.to_remove(removed, existing, wanted, strict_parity=True).collect())
    assert strict == ["u1", "u2"]


def test_change_batches(spark):
    adds = spark.range(250).select(F.format_string("u%04d", "id").alias("uri"))
    rem = spark.createDataFrame([("x1",)], "uri string")
    b = C.change_batches(adds, rem, 100)
    got = {(r.op, r.batch_no): 0 for r in b.collect()}
    counts = b.groupBy("op", "batch_no").count().orderBy("op", "batch_no").collect()
    assert [(r.op, r.batch_no, r["count"]) for r in counts] == [("add", 0, 100), ("add", 1, 100), ("add", 2, 50),
                                                                ("remove", 0, 1)]
    assert got


def test_sync_twice_is_idempotent(spark):
    """After applying the add set, a second plan adds nothing."""
    from concordia.plans.sync import plan_sync
    inp = fx.sync_inputs(spark, SF001)
    first = plan_sync(inp)
    added = first["to_add"]
    inp.target = inp.target.unionByName(added)
    second = plan_sync(inp)
    assert first["to_add"].count() > 0
    assert second["to_add"].count() == 0


def test_sync_job_publishes_and_a_dry_run_writes_nothing(spark, tmp_path):
    from concordia.plans import sync
    from concordia.sources import cache as K
    from concordia.sources import csvio
    from concordia.sources import snapshot as S
    inp, base = fx.sync_inputs(spark, SF001), str(tmp_path / "sync")
    plan = sync.plan_sync(inp, run_ts="TS")
    assert sync.publish_sync(plan, inp, base, "run-1", "2026-01-01T00-00-00", dry_run=True) is None and not os.path.exists(base)
    done = sync.publish_sync(plan, inp, base, "run-1", "2026-01-01T00-00-00")
    assert sync.publish_sync(plan, inp, base, "run-1", "2026-01-01T00-00-00") == done
    enriched = csvio.read_enriched(spark, done.tables[sync.ENRICHED_CSV])
    assert enriched.count() == plan["enriched"].count()
    assert enriched.where("audio_features_fetched").count() == enriched.where(F.col("uri") != "").count()
    assert S.load_latest_snapshot(spark, done.tables[sync.SNAPSHOT]).count() == inp.current.count()
    cache = K.read_match_cache(spark, done.tables[sync.RESULTS])
    assert cache.count() == plan["matches"].join(plan["states"], "position").select("fingerprint").distinct().count()


def test_a_write_that_fails_leaves_the_state_before(spark, tmp_path):
    from concordia.sources.published import Published
    store, df = Published(spark, str(tmp_path)), spark.range(3)
    assert store.latest() is None and store.read("a") is None
    store.publish("one", {"a": df, "b": df})
    with pytest.raises(ZeroDivisionError):
        store.publish("two", {"a": spark.range(9), "b": lambda p: 1 / 0})
    assert store.read("a").count() == 3 and [c.key for c in store.commits()] == ["one"]
    store.publish("three", {"a": spark.range(5)})
    assert (store.read("a").count(), store.read("b").count()) == (5, 3)
    assert store.publish("three", {"a": spark.range(7)}).number == 1 and store.read("a").count() == 5
    (tmp_path / "_commits" / "0000000002.json").write_text("{half")  # a writer that died while marking
    assert store.publish("four", {"a": spark.range(6)}).number == 3 and store.read("a").count() == 6
    store.vacuum(keep=1)
    assert store.read("b").count() == 3 and len(os.listdir(tmp_path / "data")) == 2


def test_nothing_new_runs_no_resolver(spark, tmp_path, monkeypatch):
    from concordia.plans import sync
    from concordia.sources.published import Published
    cur = fx.current(spark, SF001)
    full = cur.select("position", "fingerprint", "title", "artist", F.lit("cat:track:c1").alias("uri"), F.lit(5).alias("popularity"),
                      F.lit("pop").alias("artist_genres"), F.lit(3).alias("playcount"))
    monkeypatch.setattr(sync, "match_waterfall", lambda *a, **k: pytest.fail("the resolver ran"))
    inp = sync.SyncInputs(current=cur, catalog=fx.catalog(spark, SF001), previous=cur, existing=full)
    assert sync.sync_job(inp, str(tmp_path / "s"), "run-1", "2026-01-01") == "nothing new"
    assert set(Published(spark, str(tmp_path / "s")).latest().tables) == {sync.ENRICHED_CSV, sync.SNAPSHOT}
    assert not sync.nothing_to_do(sync.SyncInputs(current=cur, catalog=inp.catalog, previous=fx.keyed(spark, SF001), existing=full))
    assert not sync.nothing_to_do(sync.SyncInputs(current=cur, catalog=inp.catalog, previous=cur, existing=full.withColumn("playcount", F.lit(0))))
    assert not sync.nothing_to_do(sync.SyncInputs(current=cur, catalog=inp.catalog, previous=cur, existing=full.where("position % 5 > 0")))


def test_a_stopped_run_goes_on_after_its_last_slice(spark, tmp_path, monkeypatch):
    from concordia.plans import resume
    rows, base, ran = fx.keyed(spark, SF001), str(tmp_path), []
    index = resume.build_catalog_index(fx.catalog(spark, SF001))
    real = resume.match_waterfall
    monkeypatch.setattr(resume, "match_waterfall", lambda part, *a, **k: (ran.append(part.count()), real(part, *a, **k))[1])
    assert resume.resolved(spark, base, "r") is None
    assert not resume.resolve_in_slices(rows, index, base, "r", 3, stop_after=2) and len(ran) == 2
    assert resume.resolve_in_slices(rows, index, base, "r", 3) and len(ran) == 3 and sum(ran) == rows.count()
    assert resume.resolve_in_slices(rows, index, base, "r", 3) and len(ran) == 3
    cols = ["position", "uri", "method", "confidence"]
    whole = real(rows, index).select(cols)
    assert sorted(map(tuple, resume.resolved(spark, base, "r").select(cols).collect())) == sorted(map(tuple, whole.collect()))


def test_target_batches_are_applied_once(spark, tmp_path):
    from concordia.plans.target import apply_changes, ledger, read_target
    start = spark.createDataFrame([("a",), ("b",), ("c",)], "uri string")
    batches = spark.createDataFrame([("add", "d", 0), ("add", "e", 1), ("add", "a", 1), ("remove", "b", 0), ("remove", "a", 0)],
                                    "op string, uri string, batch_no long")
    base = str(tmp_path)
    assert apply_changes(batches, base, "r1", start, max_batches=1) == 1
    assert sorted(r.uri for r in read_target(spark, base).collect()) == ["c"]
    assert apply_changes(batches, base, "r1", start) == 2 and apply_changes(batches, base, "r1", start) == 0
    assert sorted(r.uri for r in read_target(spark, base).collect()) == ["a", "c", "d", "e"]
    assert apply_changes(batches.where("uri = 'd'"), base, "r2") == 1  # another run: already there, still once
    assert sorted(r.uri for r in read_target(spark, base).collect()) == ["a", "c", "d", "e"]
    assert ledger(spark, base).count() == 4


def test_restored_rows_take_the_whole_cache_entry(spark):
    cur = spark.createDataFrame([(1, "f1", "T", "A", ""), (2, "f2", "T", "A", "OWN"), (3, "f3", "T", "A", "")],
                                "position long, fingerprint string, title string, artist string, isrc string")
    cache = spark.createDataFrame([("f1", True, "u1", "relaxed", 0.7, "IS1", 9), ("f1", False, None, None, None, None, None),
                                   ("f2", True, "u2", None, None, "IS2", None), ("f3", False, None, None, None, None, None)],
                                  "fingerprint string, matched boolean, uri string, method string, confidence double, isrc string, track_number int")
    from concordia.plans.sync import SyncInputs, plan_sync
    inp = SyncInputs(current=cur, catalog=fx.catalog(spark, SF001), cache=cache)
    got = {r.fingerprint: (r.uri, r.match_method, r.match_confidence, r.isrc, r.track_number, r.last_synced)
           for r in plan_sync(inp, run_ts="TS")["enriched"].collect()}
    assert got == {"f1": ("u1", "relaxed", 0.7, "IS1", 9, "TS"), "f2": ("u2", "cached", 0.0, "OWN", 0, "TS"), "f3": ("", "", 0.0, "", 0, "")}


def test_contents_that_differ_are_changed(spark):
    rows = "fingerprint string, position long, title string, artist string"
    cur = spark.createDataFrame([("a", 1, "T", None), ("b", 2, "U", ""), ("c", 3, "V", "x"), ("d", 4, "W", "y")], rows)
    prev = spark.createDataFrame([("a", 9, "T", None), ("b", 2, "U", None), ("c", 3, "V2", "x"), ("e", 5, "", "")], rows)
    compare = ["title", "artist"]
    want = {"a": "unchanged", "b": "changed", "c": "changed", "d": "added", "e": "removed"}
    got = diff_snapshots(cur, prev, compare_cols=compare)
    assert {r.fingerprint: r.change_type for r in got.collect()} == want
    from concordia.operators.diff import content_hash
    stored = prev.select("fingerprint", "position", content_hash(compare).alias("content_hash"))
    assert {r.fingerprint: r.change_type for r in diff_snapshots(cur, stored, compare_cols=compare).collect()} == want


def test_enrichment_reads_every_table_once(spark):
    from concordia.operators import enrich as N
    tracks = N.with_track_defaults(fx.existing(spark, SF001))
    lookups = {n: getattr(fx, n)(spark, SF001) for n in ("catalog", "artists", "features")}
    out = N.enrich(tracks, lookups["catalog"], lookups["artists"], lookups["features"], fx.listen_stats(spark, SF001), "artist")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # features read embeddings and listen statistics read events; tracks are read for their keys and for the join
    assert plan.count("embedding#") and "Union" not in plan
    scans = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Relation")]
    assert sum("embedding#" in line for line in scans) == 1 and sum("event_type#" in line for line in scans) == 1
    assert out.count() == tracks.count()


def test_diff_against_snapshot_missing_columns(spark):
    cur = spark.createDataFrame([("a", 1, "T", "IS1"), ("b", 2, "U", "")],
                                "fingerprint string, position long, title string, isrc string")
    prev = spark.createDataFrame([("a", 1, "T"), ("c", 3, "V")], "fingerprint string, position long, title string")
    d = {r.fingerprint: (r.change_type, r.isrc) for r in diff_snapshots(cur, prev).collect()}
    assert d == {"a": ("unchanged", "IS1"), "b": ("added", ""), "c": ("removed", None)}


def test_limit_edges_and_first_run_plan(spark):
    df = spark.createDataFrame([(p, f"f{p}") for p in [3, 1, 2]], "position long, fingerprint string")
    assert {r.state for r in C.limit_pending(df, None).collect()} == {"search"}
    assert {r.state for r in C.limit_pending(df, 0).collect()} == {"pending"}
    assert {r.state for r in C.limit_pending(df, 10).collect()} == {"search"}
    # first run: no previous state, no enriched table, no cache, no target
    from concordia.plans.sync import SyncInputs, plan_sync
    inp = SyncInputs(current=fx.current(spark, SF001), catalog=fx.catalog(spark, SF001))
    plan = plan_sync(inp, limit=50)
    s = plan["summary"].first()
    assert (s.total, s.already_matched, s.restored, s.pending) == (184, 0, 0, 184 - 50)
    assert s.newly_matched + s.unmatched == 50
    assert plan["to_remove"].count() == 0
    assert plan["to_add"].count() == plan["matches"].where("matched").select("uri").distinct().count()
