"""Registered queries: one per operator group, each over the whole driver tables.

Every callable takes (spark, sf_dir) and returns a DataFrame whose column
names equal those of the matching oracle SQL in ``concordia.oracle_queries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.config import DURATION_TOLERANCE_SEC, SEARCH_LIMIT, MatchConfig
from concordia.functions import text as X
from concordia.operators.diff import diff_counts, diff_snapshots
from concordia.operators.keys import dedupe_last_wins
from concordia.operators.match import (match_single_pass, match_waterfall, prepare_catalog, prepare_source,
                                       score_candidates, search_candidates)
from concordia.operators.ranges import band_join
from concordia.sources import fixtures as fx
from concordia.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- step 1: keys, diff
@query("q_fingerprint")
def q_fingerprint(spark, d):
    return fx.keyed(spark, d).select("position", "fingerprint")


@query("q_dedupe_last_wins")
def q_dedupe_last_wins(spark, d):
    return dedupe_last_wins(fx.current(spark, d), "fingerprint", "position").select("fingerprint", "position", "title")


def _diff(spark, d):
    return diff_snapshots(fx.current(spark, d), fx.previous(spark, d), "fingerprint", "position",
                          cols=["position", "title"])


@query("q_diff")
def q_diff(spark, d):
    return _diff(spark, d)


@query("q_diff_summary")
def q_diff_summary(spark, d):
    return diff_counts(_diff(spark, d))


@query("q_diff_changed")
def q_diff_changed(spark, d):
    """Diff that tells changed contents: the latest snapshot stores their hash."""
    snaps = scratch_path(spark, "changed-snapshots")
    S.save_snapshot(fx.previous(spark, d), snaps, SNAP_TS[0])
    diff = J.diff_job(fx.current(spark, d), spark, snaps, changed=True)["diff"]
    return diff.select("fingerprint", "change_type", "position")


@query("q_first_run")
def q_first_run(spark, d):
    return diff_snapshots(fx.current(spark, d), None, "fingerprint", cols=["position", "title"])


# ---------------------------------------------------------------- step 2: text
@query("q_normalize")
def q_normalize(spark, d):
    s = fx.source(spark, d)
    return s.select("position", X.normalize_text("title").alias("norm_title"),
                    X.normalize_text("artist").alias("norm_artist"),
                    X.normalize_text(X.first_artist("artist")).alias("norm_first_artist"))


@query("q_query_string")
def q_query_string(spark, d):
    s = fx.source(spark, d)
    return s.select("position", X.query_string(X.normalize_text("title"),
                                               X.normalize_text(X.first_artist("artist"))).alias("query"))


@query("q_first_artist")
def q_first_artist(spark, d):
    return fx.source(spark, d).select("position", X.first_artist("artist").alias("first_artist"))


@query("q_html_titles")
def q_html_titles(spark, d):
    p = read_table(spark, d, "pages", ["page_id", "html"])
    raw = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return p.select("page_id", raw.alias("title_raw"), X.normalize_text(raw).alias("title"))


@query("q_duration_close")
def q_duration_close(spark, d):
    s = fx.source(spark, d).select("position", "duration")
    c = fx.catalog(spark, d).select("catalog_id", "duration_ms")
    j = s.join(c, c.catalog_id == F.concat(F.lit("c"), F.col("position").cast("string")))
    return j.select("position", X.duration_close("duration", "duration_ms").alias("close"))


@query("q_duration_band")
def q_duration_band(spark, d):
    """Strict duration filter: catalogue rows of the same artist within the
    tolerance, by a bucketed range join; how many and the closest per item."""
    s = fx.source(spark, d).where("duration > 0").select("position", F.col("album").alias("kind"), "duration")
    c = fx.catalog(spark, d).groupBy(F.col("album_type").alias("kind"), (F.col("duration_ms") / 1000.0).alias("seconds")).agg(
        F.count(F.lit(1)).alias("n"), F.min("uri").alias("uri"))  # rows of one duration are alike: one per duration is joined
    j = band_join(s.select("kind", "duration").distinct(), c, ["kind"], "duration", "seconds", DURATION_TOLERANCE_SEC)
    found = j.groupBy("kind", "duration").agg(F.sum("n").alias("n_close"),
                                              F.min_by("uri", F.struct(F.abs(F.col("duration") - F.col("seconds")), "uri")).alias("closest"))
    return s.join(found, ["kind", "duration"]).select("position", "n_close", "closest")


def duration_payload(src: DataFrame) -> DataFrame:
    """Source rows as playlist-style duration fields (text and numeric)."""
    dsec = F.col("duration").cast("long")
    mm = F.floor(dsec / 60).cast("long").cast("string")
    ss = F.lpad((dsec % 60).cast("string"), 2, "0")
    p = F.col("position")
    text = (F.when(p % 4 == 0, F.concat(mm, F.lit(":"), ss))
            .when(p % 4 == 1, F.concat(F.lit("0:"), mm, F.lit(":"), ss))
            .when(p % 4 == 2, dsec.cast("string"))
            .otherwise(F.concat(F.lit("a:"), (dsec % 60).cast("string"))))
    num = (F.when(p % 5 == 0, F.col("duration").cast("string"))
           .when(p % 5 == 1, F.lit("x")).when(p % 5 == 2, F.lit("0")))
    return src.select("position", text.alias("duration_text"), num.alias("duration_seconds"))


@query("q_duration_parse")
def q_duration_parse(spark, d):
    pl = duration_payload(fx.source(spark, d))
    return pl.select("position", X.parse_duration("duration_seconds", "duration_text").alias("seconds"))


# ---------------------------------------------------------------- step 3/4: resolver
_OUT = ["uri", "method", "confidence"]


@query("q_match_isrc")
def q_match_isrc(spark, d):
    r = match_single_pass(fx.source(spark, d), fx.catalog(spark, d), "isrc")
    return r.select("position", *_OUT)


def _scored(spark, d, metric):
    cfg = MatchConfig(metric=metric)
    prepared = cut_lineage(prepare_source(fx.source(spark, d), "position"), "prepared")
    index = cut_lineage(prepare_catalog(fx.catalog(spark, d)), "catalog-index")
    sc = score_candidates(prepared, index, cfg, with_artist=True, prune_threshold=None)
    return sc.select("s_title", "s_first_artist", "s_artist", "s_duration", "uri",
                     F.col("rank").alias("cand_rank"), "score", "eff")


@query("q_score_ratio")
def q_score_ratio(spark, d):
    return _scored(spark, d, "ratio")


@query("q_score_levenshtein")
def q_score_levenshtein(spark, d):
    return _scored(spark, d, "levenshtein")


@query("q_candidates_topk")
def q_candidates_topk(spark, d):
    prepared = prepare_source(fx.source(spark, d), "position")
    index = cut_lineage(prepare_catalog(fx.catalog(spark, d)), "catalog-index")
    cands, _, _ = search_candidates(prepared, index, MatchConfig(max_candidates=SEARCH_LIMIT), with_artist=True)
    return cands.select("s_title", "s_first_artist", "uri", F.col("rank").alias("cand_rank"))


@query("q_match_title_artist")
def q_match_title_artist(spark, d):
    r = match_single_pass(fx.source(spark, d), fx.catalog(spark, d), "title_artist")
    return r.select("position", *_OUT)


@query("q_match_relaxed")
def q_match_relaxed(spark, d):
    r = match_single_pass(fx.source(spark, d), fx.catalog(spark, d), "relaxed")
    return r.select("position", *_OUT)


@query("q_match_waterfall")
def q_match_waterfall(spark, d):
    r = match_waterfall(fx.source(spark, d), fx.catalog(spark, d), MatchConfig())
    return r.select("position", *_OUT, "matched")


@query("q_match_thresholds")
def q_match_thresholds(spark, d):
    r = match_waterfall(fx.source(spark, d), fx.catalog(spark, d), MatchConfig(pass3_threshold=0.6))
    return r.select("position", *_OUT, "matched")


# ---------------------------------------------------------------- step 5: sync plan
from concordia.operators import changes as C  # noqa: E402
from concordia.operators import enrich as N  # noqa: E402
from concordia.operators import report as R  # noqa: E402
from concordia.operators.match import build_catalog_index  # noqa: E402
from concordia.plans.resume import resolve_in_slices, resolved  # noqa: E402
from concordia.plans.sync import ENRICHED_CSV, RESULTS, SNAPSHOT, UNMATCHED_CSV, plan_sync, publish_sync  # noqa: E402
from concordia.plans.target import apply_changes, read_target  # noqa: E402
from concordia.session import cut_lineage, scratch_path  # noqa: E402

RUN_TS = "2026-01-01T00:00:00"
SYNCED_COLS = ["uri", "catalog_url", "match_method", "match_confidence", "isrc", "explicit", "release_date", "duration_ms",
               "popularity", "album_type", "track_number", "first_synced", "last_synced"]
LIMIT_N = 250


@query("q_split_existing")
def q_split_existing(spark, d):
    s = C.split_existing(fx.current(spark, d), fx.existing(spark, d))
    return s.select("position", "fingerprint", "state", "existing_uri")


def _needs(spark, d):
    s = C.split_existing(fx.current(spark, d), fx.existing(spark, d))
    return s.where(F.col("state") == C.NEEDS).drop("state")


@query("q_cache_split")
def q_cache_split(spark, d):
    cs = C.cache_split(_needs(spark, d), fx.cache(spark, d))
    return cs.select("position", "fingerprint", "state", "cache_uri")


@query("q_limit_pending")
def q_limit_pending(spark, d):
    cs = C.cache_split(_needs(spark, d), fx.cache(spark, d))
    search = cs.where(F.col("state") == C.SEARCH).drop("state")
    return C.limit_pending(search, LIMIT_N).select("position", "fingerprint", "state")


def _plan(spark, d):
    return plan_sync(fx.sync_inputs(spark, d), run_ts=RUN_TS)


@query("q_to_add")
def q_to_add(spark, d):
    return _plan(spark, d)["to_add"]


@query("q_to_remove")
def q_to_remove(spark, d):
    return _plan(spark, d)["to_remove"]


@query("q_change_batches")
def q_change_batches(spark, d):
    return _plan(spark, d)["batches"]


@query("q_sync_summary")
def q_sync_summary(spark, d):
    return _plan(spark, d)["summary"]


@query("q_sync_limited")
def q_sync_limited(spark, d):
    """Sync with a per-run limit: only the first LIMIT_N rows still to search
    are resolved; the rest stay pending for a later run."""
    return plan_sync(fx.sync_inputs(spark, d), limit=LIMIT_N, run_ts=RUN_TS)["summary"]


@query("q_sync_enriched")
def q_sync_enriched(spark, d):
    """The run's enriched table: already resolved + cache hits + new matches + unresolved."""
    return _plan(spark, d)["enriched"].select("position", "fingerprint", *SYNCED_COLS)


@query("q_target_applied")
def q_target_applied(spark, d):
    """The target after the run's write batches: two of them, then (as after a
    stop) the whole run again, and once more, which changes nothing."""
    inp = fx.sync_inputs(spark, d)
    batches = cut_lineage(plan_sync(inp, run_ts=RUN_TS)["batches"], "write-batches")
    base = scratch_path(spark, "target")
    first = apply_changes(batches, base, "run-1", inp.target, max_batches=2)
    rest = apply_changes(batches, base, "run-1", inp.target)
    again = apply_changes(batches, base, "run-1", inp.target)
    if again or first + rest != batches.select("op", "batch_no").distinct().count():
        raise AssertionError("a batch was applied twice, or not at all")
    return read_target(spark, base)


@query("q_match_resumed")
def q_match_resumed(spark, d):
    """The waterfall in three committed slices, stopped after the first and resumed."""
    base, rows = scratch_path(spark, "progress"), fx.keyed(spark, d)
    index = build_catalog_index(fx.catalog(spark, d), MatchConfig())
    if resolve_in_slices(rows, index, base, "run-1", 3, stop_after=1) or not resolve_in_slices(rows, index, base, "run-1", 3):
        raise AssertionError("the run did not stop, or did not go on")
    return resolved(spark, base, "run-1").select("position", *_OUT, "matched")


@query("q_retry_upsert")
def q_retry_upsert(spark, d):
    """Unmatched export (6 columns) -> resolve again -> upsert into enriched."""
    from concordia.plans.jobs import retry_unmatched
    from concordia.sources import csvio
    ex = fx.enriched(spark, d)
    path = scratch_path(spark, "unmatched-csv")
    csvio.write_unmatched(ex.where(F.col("uri") == ""), path)
    plan = retry_unmatched(spark, path, ex, fx.catalog(spark, d), MatchConfig(), RUN_TS)
    return plan["enriched"].select("fingerprint", "uri", "match_method")


# ---------------------------------------------------------------- step 6: enrichment
@query("q_apply_match")
def q_apply_match(spark, d):
    tracks = N.with_track_defaults(fx.keyed(spark, d))
    res = match_waterfall(fx.source(spark, d), fx.catalog(spark, d), MatchConfig(), id_col="position")
    a = N.apply_match(tracks, res, "position", RUN_TS)
    return a.select("position", "uri", "match_method", "match_confidence", "isrc", "duration_ms",
                    "popularity", "first_synced", "last_synced")


@query("q_backfill_metadata")
def q_backfill_metadata(spark, d):
    b = N.backfill_metadata(fx.enriched(spark, d), fx.catalog(spark, d))
    return b.select("position", "uri", "duration_ms", "explicit", "popularity", "track_number",
                    "release_date", "album_type", "isrc")


@query("q_backfill_genres")
def q_backfill_genres(spark, d):
    b = N.backfill_genres(fx.enriched(spark, d), fx.catalog(spark, d), fx.artists(spark, d), "artist")
    return b.select("position", "uri", "artist_genres")


@query("q_audio_features")
def q_audio_features(spark, d):
    from concordia.schema import AUDIO_FEATURES
    b = N.audio_features(fx.enriched(spark, d), fx.features(spark, d))
    return b.select("position", "uri", *AUDIO_FEATURES, "audio_features_fetched")


@query("q_listen_stats")
def q_listen_stats(spark, d):
    b = N.listen_stats(fx.enriched(spark, d), fx.listen_stats(spark, d))
    return b.select("position", "playcount", "listeners", "tags")


@query("q_needs_enrichment")
def q_needs_enrichment(spark, d):
    return N.needs_enrichment(fx.enriched(spark, d))


# ---------------------------------------------------------------- step 8: reports
@query("q_match_rate")
def q_match_rate(spark, d):
    return R.match_rate(fx.enriched(spark, d))


@query("q_method_breakdown")
def q_method_breakdown(spark, d):
    return R.method_breakdown(fx.enriched(spark, d))


@query("q_status")
def q_status(spark, d):
    """The status job over published exports and two snapshots."""
    base, snaps = scratch_path(spark, "published"), scratch_path(spark, "status-snapshots")
    S.save_snapshot(fx.previous(spark, d), snaps, SNAP_TS[0])
    S.save_snapshot(fx.current(spark, d), snaps, SNAP_TS[1])
    e = fx.enriched(spark, d)
    Published(spark, base).publish("run-1", {
        ENRICHED_CSV: lambda p: csvio.write_enriched(e, p),
        UNMATCHED_CSV: lambda p: csvio.write_unmatched(e.where(F.col("uri") == ""), p)})
    return J.status_job(spark, fx.source(spark, d), base, snaps)


@query("q_preview")
def q_preview(spark, d):
    p = R.preview(_diff(spark, d), 20)
    return p.select("change_type", "fingerprint", "position", "title", "row_no", "type_total")


@query("q_listen_coverage")
def q_listen_coverage(spark, d):
    b = N.listen_stats(fx.enriched(spark, d), fx.listen_stats(spark, d))
    return b.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("playcount") > 0).alias("with_listen_stats"))


# ---------------------------------------------------------------- step 7: I/O
from concordia.sources import cache as K  # noqa: E402
from concordia.sources import csvio  # noqa: E402
from concordia.sources import payloads as P  # noqa: E402
from concordia.sources import snapshot as S  # noqa: E402
from concordia.sources.published import Published  # noqa: E402

@query("q_csv_roundtrip")
def q_csv_roundtrip(spark, d):
    """Enriched table -> 40-column export -> read back typed."""
    path = scratch_path(spark, "enriched-csv")
    csvio.write_enriched(_enriched(spark, d), path)
    return csvio.read_enriched(spark, path)


def _enriched(spark, d):
    return N.enrich(fx.enriched(spark, d), fx.catalog(spark, d), fx.artists(spark, d), fx.features(spark, d),
                    fx.listen_stats(spark, d), "artist")


@query("q_enrich")
def q_enrich(spark, d):
    """Metadata, genres, features and listen statistics in two lookups."""
    return _enriched(spark, d).select("position", "uri", "duration_ms", "explicit", "popularity", "track_number", "release_date",
                                      "album_type", "isrc", "artist_genres", "danceability", "key", "audio_features_fetched",
                                      "playcount", "listeners", "tags")


SNAP_TS = ("2026-01-01T00-00-00", "2026-01-02T00-00-00")


@query("q_snapshot_roundtrip")
def q_snapshot_roundtrip(spark, d):
    base = scratch_path(spark, "snapshots")
    S.save_snapshot(fx.previous(spark, d), base, SNAP_TS[0])
    S.save_snapshot(fx.current(spark, d), base, SNAP_TS[1])
    latest = S.load_latest_snapshot(spark, base)
    return latest.select("position", "platform", "track_id", "title", "artist", "album", "duration",
                         "fingerprint", "snapshot_ts")


@query("q_snapshot_history")
def q_snapshot_history(spark, d):
    base = scratch_path(spark, "snapshots")
    S.save_snapshot(fx.previous(spark, d), base, SNAP_TS[0])
    S.save_snapshot(fx.current(spark, d), base, SNAP_TS[1])
    return S.snapshot_history(spark, base)


@query("q_payload_flatten")
def q_payload_flatten(spark, d):
    src = fx.source(spark, d)
    pl = src.join(duration_payload(src), "position")
    pages = P.build_playlist_pages(pl, "pl-main", 100, null_item=(F.col("position") % 13 == 0))
    path = scratch_path(spark, "playlist-pages")
    pages.write.json(path)
    flat = P.flatten_playlist(P.read_playlist_pages(spark, path))
    return flat.select("position", "platform", "track_id", "title", "artist", "album", "isrc", "duration", "url")


def listen_payload_rows(stats: DataFrame) -> DataFrame:
    """Listen statistics as service payloads: 'rod' titles come back as an
    error, every 7th play count is malformed, each tag list carries a
    nameless tag."""
    track = F.struct(
        F.when(F.col("playcount") % 7 == 0, F.lit("n/a")).otherwise(F.col("playcount").cast("string"))
         .alias("playcount"),
        F.col("listeners").cast("string").alias("listeners"),
        F.struct(F.concat(F.transform("tags", lambda t: F.struct(t.alias("name"))),
                          F.array(F.struct(F.lit("").alias("name")))).alias("tag")).alias("toptags"))
    err = F.col("title").contains("rod")
    return stats.select(
        F.col("artist").alias("lookup_artist"), F.col("title").alias("lookup_title"),
        F.when(err, F.lit(6).cast("long")).alias("error"),
        F.when(err, F.lit("Track not found")).alias("message"),
        F.when(~err, track).alias("track"))


@query("q_listen_payload")
def q_listen_payload(spark, d):
    path = scratch_path(spark, "listen-payloads")
    listen_payload_rows(fx.listen_stats(spark, d)).write.json(path)
    parsed = P.parse_listen_payloads(P.read_listen_payloads(spark, path))
    return parsed.select("artist", "title", "playcount", "listeners",
                         F.array_join("tags", ", ").alias("tags"))


@query("q_cache_roundtrip")
def q_cache_roundtrip(spark, d):
    base = scratch_path(spark, "match-results")
    c = fx.cache(spark, d)
    K.write_match_results(c.where("matched"), base, "run-1")
    K.write_match_results(c.where(~F.col("matched")), base, "run-2")
    return K.read_match_cache(spark, base).select("fingerprint", "matched", F.coalesce("uri", F.lit("")).alias("uri"), "url", "method",
                                                  "confidence", "isrc", "explicit", "album_release_date", "duration_ms",
                                                  "popularity", "album_type", "track_number")


# ---------------------------------------------------------------- step 9: streaming
from concordia.streaming import incremental as T9  # noqa: E402


def _stream(spark, d, resolve=False):
    """Three arrivals of the current list: first the rows that stand later in it,
    then odd and even positions; the state is compacted after every second."""
    cur = fx.current(spark, d)
    p = F.col("position")
    arrival = F.when(p >= fx.LATER, F.lit(0)).otherwise(2 - p % 2)
    landing, state, checkpoint = (scratch_path(spark, n) for n in ("landing", "stream-state", "stream-ckpt"))
    index = build_catalog_index(fx.catalog(spark, d), MatchConfig()) if resolve else None
    for k in range(3):
        T9.land(cur.where(arrival == k), landing)
        T9.run_incremental(spark, landing, cur.schema, state, checkpoint, existing=fx.existing(spark, d), catalog=index,
                           cfg=MatchConfig(), compact_every=2)
    return state


@query("q_stream_incremental")
def q_stream_incremental(spark, d):
    state = _stream(spark, d)
    return T9.read_state(spark, state).select("fingerprint", "position", "title")


@query("q_stream_matches")
def q_stream_matches(spark, d):
    """Arrivals resolved batch by batch (only rows not already resolved)."""
    state = _stream(spark, d, resolve=True)
    return T9.read_matches(spark, state).select("position", *_OUT, "matched")


@query("q_stream_split")
def q_stream_split(spark, d):
    state = _stream(spark, d)
    return T9.read_split(spark, state).select("position", "fingerprint", "state", "existing_uri")


# ---------------------------------------------------------------- composite jobs
from concordia.plans import jobs as J  # noqa: E402

SOURCE_EXPORT = {"title": "title", "artist": "artist", "album": "album", "isrc": "isrc", "platform": "platform",
                 "trackId": "track_id"}


@query("q_import_csv")
def q_import_csv(spark, d):
    """List export -> import job (snapshot + enriched file) -> enriched file read back."""
    src = fx.source(spark, d)
    csv_path = scratch_path(spark, "source-csv")
    export = src.select(*[F.col(v).alias(k) for k, v in SOURCE_EXPORT.items()],
                        F.when(F.col("duration") != 0, F.col("duration").cast("string")).otherwise(F.lit(""))
                        .alias("duration"))
    csvio.write_csv(export, csv_path)
    plan = J.import_csv(spark, csv_path)
    snaps, enriched = scratch_path(spark, "import-snapshots"), scratch_path(spark, "import-enriched")
    J.write_import(plan, snaps, enriched, SNAP_TS[0])
    back = N.with_track_defaults(csvio.read_enriched(spark, enriched))
    from concordia.operators.keys import fingerprint
    return back.select("title", "artist", "album", "isrc", "platform", "track_id", "duration",
                       fingerprint().alias("fingerprint"))


@query("q_diff_job")
def q_diff_job(spark, d):
    """Snapshot the previous state, flatten the current playlist pages, diff."""
    snaps = scratch_path(spark, "diff-snapshots")
    S.save_snapshot(fx.previous(spark, d), snaps, SNAP_TS[0])
    cur = fx.current(spark, d)
    pl = cur.join(duration_payload(cur), "position")
    pages_path = scratch_path(spark, "diff-pages")
    P.build_playlist_pages(pl, "pl-main", 100).write.json(pages_path)
    current = J.snapshot_from_pages(spark, pages_path)
    return J.diff_job(current, spark, snaps)["summary"]


@query("q_snapshot_job")
def q_snapshot_job(spark, d):
    """Playlist pages -> snapshot job -> the snapshot read back."""
    cur = fx.current(spark, d)
    pages, snaps = scratch_path(spark, "job-pages"), scratch_path(spark, "job-snapshots")
    P.build_playlist_pages(cur.join(duration_payload(cur), "position"), "pl-main", 100).write.json(pages)
    J.snapshot_job(spark, pages, snaps, SNAP_TS[0])
    return S.load_latest_snapshot(spark, snaps).select("platform", "track_id", "title", "artist", "album", "duration", "fingerprint")


@query("q_sync_published")
def q_sync_published(spark, d):
    """A sync run's commit, read back: how many rows each of its tables holds."""
    inp, base = fx.sync_inputs(spark, d), scratch_path(spark, "sync-published")
    publish_sync(plan_sync(inp, run_ts=RUN_TS), inp, base, "run-1", SNAP_TS[1])
    store = Published(spark, base)
    enriched = csvio.read_enriched(spark, store.path(ENRICHED_CSV))
    tables = {"enriched": enriched, "enriched_resolved": enriched.where(F.col("uri") != ""),
              "features_fetched": enriched.where("audio_features_fetched"),
              "unmatched": csvio.read_csv_strings(spark, store.path(UNMATCHED_CSV)),
              "snapshot": S.load_latest_snapshot(spark, store.path(SNAPSHOT)),
              "results_matched": K.read_match_cache(spark, store.path(RESULTS)).where("matched")}
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("q_retry_published")
def q_retry_published(spark, d):
    """The retry job's commit, read back: resolved rows of the enriched export."""
    ex, path, base = fx.enriched(spark, d), scratch_path(spark, "unmatched-csv"), scratch_path(spark, "retry-published")
    csvio.write_unmatched(ex.where(F.col("uri") == ""), path)
    J.publish_retry(J.retry_unmatched(spark, path, ex, fx.catalog(spark, d), MatchConfig(), RUN_TS), base, "run-1")
    return csvio.read_enriched(spark, Published(spark, base).path(ENRICHED_CSV)).where(F.col("uri") != "").select("uri", "match_method")


@query("q_listen_job")
def q_listen_job(spark, d):
    """The listen job without an enriched export: the latest snapshot's rows."""
    base, snaps = scratch_path(spark, "listen-published"), scratch_path(spark, "listen-snapshots")
    S.save_snapshot(fx.current(spark, d), snaps, SNAP_TS[0])
    J.publish_listen(spark, base, "run-1", fx.listen_stats(spark, d), snaps)
    return csvio.read_enriched(spark, Published(spark, base).path(ENRICHED_CSV)).select(
        "platform", "track_id", "title", "artist", "playcount", "listeners", "tags")


@query("q_bulk_lookup")
def q_bulk_lookup(spark, d):
    """Catalogue rows for the distinct ids of resolved rows (one semi join)."""
    ids = fx.enriched(spark, d).where(F.col("uri") != "").select(X.uri_id("uri").alias("catalog_id"))
    return N.lookup_by_ids(fx.catalog(spark, d), ids, "catalog_id").select(
        "catalog_id", "uri", "duration_ms", "popularity")


def catalog_payload_rows(cat: DataFrame) -> DataFrame:
    """Catalogue rows as nested service payloads (artist list, album and id
    structs); every 9th track lacks its album, every 10th its popularity.
    The link base is a placeholder address."""
    k = F.substring(F.col("catalog_id"), 2, 20).cast("long")
    return cat.select(
        F.col("catalog_id").alias("id"), "uri", "name", "duration_ms", "explicit",
        F.when(k % 10 != 0, F.col("popularity")).alias("popularity"), "track_number",
        F.struct(F.col("isrc")).alias("external_ids"),
        F.struct(F.concat(F.lit("https://open.example/track/"), F.col("catalog_id")).alias("spotify"))
         .alias("external_urls"),
        F.when(k % 9 != 0, F.struct(F.col("release_date"), F.col("album_type"))).alias("album"),
        F.array(F.struct(F.col("artist").alias("name"), F.col("artist").alias("id"))).alias("artists"))


@query("q_catalog_payload")
def q_catalog_payload(spark, d):
    """Nested catalogue tracks -> flat catalogue table."""
    path = scratch_path(spark, "catalog-tracks")
    catalog_payload_rows(fx.catalog(spark, d)).write.json(path)
    return P.catalog_from_payload(P.read_catalog_tracks(spark, path))


@query("q_target_pages")
def q_target_pages(spark, d):
    """Target list pages (at most 100 items each, every 7th track null) -> uris."""
    tgt = catalog_payload_rows(fx.catalog(spark, d))
    n = F.col("id").substr(2, 20).cast("long")
    items = tgt.select(F.floor(n / 100).cast("long").alias("page"), (n % 100).alias("pos"),
                       F.when(n % 7 != 0, F.struct(*tgt.columns)).alias("track"))
    pages = (items.groupBy("page")
                  .agg(F.array_sort(F.collect_list(F.struct("pos", "track"))).alias("l"))
                  .select("page", F.transform("l", lambda e: F.struct(e["track"].alias("track"))).alias("items")))
    path = scratch_path(spark, "target-pages")
    pages.write.json(path)
    return P.flatten_target(P.read_target_pages(spark, path)).select("uri", "catalog_id", "artist_id")



@query("q_artist_payload")
def q_artist_payload(spark, d):
    """Artist payloads (every 4th without a genre list) -> genre text per artist."""
    a = fx.artists(spark, d)
    n = F.substring_index("artist_id", "#", -1).cast("long")
    path = scratch_path(spark, "artist-payloads")
    a.select(F.col("artist_id").alias("id"), F.when(n % 4 != 0, F.col("genres")).alias("genres")).write.json(path)
    r = P.read_artists(spark, path)
    return r.select("artist_id", F.array_join("genres", ", ").alias("genre_text"))


@query("q_features_payload")
def q_features_payload(spark, d):
    """Audio-feature payloads (tempo absent on every 5th) -> typed features."""
    from concordia.schema import AUDIO_FEATURES
    f = fx.features(spark, d)
    n = F.substring(F.col("catalog_id"), 2, 20).cast("long")
    path = scratch_path(spark, "feature-payloads")
    f.select(F.col("catalog_id").alias("id"), *[c for c in AUDIO_FEATURES if c != "tempo"],
             F.when(n % 5 != 0, F.col("tempo")).alias("tempo")).write.json(path)
    return P.read_features(spark, path).select("catalog_id", *AUDIO_FEATURES)
