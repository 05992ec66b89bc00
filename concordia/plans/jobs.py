"""The user-level jobs besides sync, each a composition of operators.

A job returns a dict of lazy DataFrames (its plan); ``publish_*`` writes what it
changed as one commit.  Nothing is written in a dry run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.config import MatchConfig
from concordia.operators import changes as C
from concordia.operators import enrich as N
from concordia.operators import report as R
from concordia.operators.diff import diff_counts, diff_snapshots
from concordia.operators.keys import with_fingerprint
from concordia.operators.match import match_waterfall
from concordia.plans.sync import ENRICHED_CSV, UNMATCHED_CSV
from concordia.session import cut_lineage
from concordia.sources import csvio
from concordia.sources import payloads as P
from concordia.sources import snapshot as S
from concordia.sources.published import Commit, Published, has_files


def import_csv(spark: SparkSession, csv_path: str, mode: str = "strict") -> dict[str, DataFrame]:
    """Bootstrap from a list export: the tracks become the first snapshot and
    the initial enriched table."""
    tracks = with_fingerprint(csvio.read_source_tracks(spark, csv_path, mode))
    return {"tracks": tracks, "preview": tracks.orderBy("position").limit(5)}


def write_import(plan: dict[str, DataFrame], snapshot_base: str, enriched_path: str, snapshot_ts: str) -> None:
    tracks = plan["tracks"]
    S.save_snapshot(tracks, snapshot_base, snapshot_ts)
    csvio.write_enriched(tracks, enriched_path)


def snapshot_from_pages(spark: SparkSession, pages_path: str, platform: str = "ytmusic") -> DataFrame:
    """Current list state from landed playlist pages."""
    return P.flatten_playlist(P.read_playlist_pages(spark, pages_path), platform)


def snapshot_job(spark: SparkSession, pages_path: str, snapshot_base: str, snapshot_ts: str,
                 platform: str = "ytmusic", dry_run: bool = False) -> DataFrame:
    """Take the list from its landed pages and append it to the snapshots."""
    tracks = cut_lineage(snapshot_from_pages(spark, pages_path, platform), "snapshot")
    if not dry_run:
        S.save_snapshot(tracks, snapshot_base, snapshot_ts)
    return tracks


def diff_job(current: DataFrame, spark: SparkSession, snapshot_base: str | None, preview_rows: int = 20,
             changed: bool = False) -> dict[str, DataFrame]:
    """Changes since the latest snapshot (no snapshot: everything is added).
    With ``changed``, rows of one key whose contents differ are told apart by the
    hash that snapshots store."""
    prev = S.load_latest_snapshot(spark, snapshot_base)
    cols = ["position", "title", "artist"]
    compare = S.CONTENT_COLS if changed else None
    d = diff_snapshots(current, prev.select("fingerprint", "content_hash", *cols) if prev is not None else None,
                       "fingerprint", "position", cols=cols, compare_cols=compare)
    return {"diff": d, "summary": diff_counts(d), "preview": R.preview(d, preview_rows)}


def retry_unmatched(spark: SparkSession, unmatched_path: str, enriched: DataFrame, catalog: DataFrame,
                    cfg: MatchConfig | None = None, run_ts: str = "1970-01-01T00:00:00",
                    target: DataFrame | None = None) -> dict[str, DataFrame]:
    """Resolve the rows of the unmatched export again; newly resolved rows
    replace their fingerprint's rows in the enriched table."""
    um = with_fingerprint(csvio.read_source_tracks(spark, unmatched_path))
    res = match_waterfall(um, catalog, cfg or MatchConfig(), id_col="position")
    newly = N.apply_match(um, res.where("matched"), "position", run_ts).where(F.col("uri") != "")
    still = um.join(newly.select("position"), "position", "left_anti")
    cols = [c for c, _ in N.TRACK_COLUMNS]
    upserted = C.retry_upsert(N.with_track_defaults(enriched).select("fingerprint", *cols),
                              newly.select("fingerprint", *cols), "fingerprint")
    out = {"newly_matched": newly, "still_unmatched": still, "enriched": upserted}
    if target is not None:
        out["to_add"] = C.to_add(newly.select("uri"), target)
    return out


def publish_retry(plan: dict[str, DataFrame], base: str, run_id: str, dry_run: bool = False) -> Commit | None:
    """Write what a retry changed, as one commit: both exports, and the uris to add
    if the plan has them.  Where nothing was newly resolved nothing is written."""
    if dry_run or not plan["newly_matched"].take(1):
        return None
    tables = {ENRICHED_CSV: lambda p: csvio.write_enriched(plan["enriched"], p),
              UNMATCHED_CSV: lambda p: csvio.write_unmatched(plan["still_unmatched"], p)}
    if "to_add" in plan:
        tables["to_add"] = plan["to_add"]
    return Published(plan["enriched"].sparkSession, base).publish(run_id, tables)


def listen_job(tracks: DataFrame, listen: DataFrame) -> dict[str, DataFrame]:
    """Listen statistics for every row still without them (resolved or not)."""
    t = N.listen_stats(N.with_track_defaults(tracks), listen)
    cov = t.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("playcount") > 0).alias("with_listen_stats"))
    return {"enriched": t, "coverage": cov}


def publish_listen(spark: SparkSession, base: str, run_id: str, listen: DataFrame, snapshot_base: str | None = None,
                   dry_run: bool = False) -> Commit | None:
    """Listen statistics for the published enriched export or, where there is none
    yet, for the latest snapshot; the export is published with them."""
    store = Published(spark, base)
    path = store.path(ENRICHED_CSV)
    tracks = csvio.read_enriched(spark, path) if path else S.load_latest_snapshot(spark, snapshot_base)
    if tracks is None:
        raise ValueError("neither an enriched export nor a snapshot: import, snapshot or sync first")
    if dry_run:
        return None
    rows = listen_job(tracks, listen)["enriched"]
    return store.publish(run_id, {ENRICHED_CSV: lambda p: csvio.write_enriched(rows, p)})


def status_job(spark: SparkSession, source: DataFrame | None, base: str | None, snapshot_base: str | None = None) -> DataFrame:
    """The status report over what the last run published and the snapshots."""
    store = Published(spark, base) if base else None
    enriched, unmatched = (store.path(n) if store else None for n in (ENRICHED_CSV, UNMATCHED_CSV))
    snapshots = spark.read.parquet(snapshot_base) if has_files(spark, snapshot_base) else None
    return R.status(source, csvio.read_enriched(spark, enriched) if enriched else None,
                    csvio.read_csv_strings(spark, unmatched) if unmatched else None, snapshots)
