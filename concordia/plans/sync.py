"""Composite jobs as plans: build every output lazily, write in ``apply``.

``plan_sync`` is the whole sync: diff against the previous state, split the
current list by the enriched table and the match cache, resolve what is
left (optionally only the first ``limit`` rows), derive idempotent add /
remove change sets against the target, enrich, and report.  A dry run is
simply not calling ``apply``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.config import MatchConfig
from concordia.operators import changes as C
from concordia.operators import enrich as N
from concordia.operators.keys import dedupe_last_wins
from concordia.functions.text import blank
from concordia.operators.diff import REMOVED, diff_counts, diff_snapshots
from concordia.operators.match import match_waterfall
from concordia.operators.report import sync_summary
from concordia.plans.resume import resolve_in_slices, resolved
from concordia.session import cut_lineage
from concordia.sources import cache as K
from concordia.sources import csvio
from concordia.sources import snapshot as S
from concordia.sources.published import Commit, Published


@dataclass
class SyncInputs:
    current: DataFrame                      # position, platform, track_id, title, artist, album, isrc, duration, fingerprint
    catalog: DataFrame                      # catalog_id, uri, name, artist, isrc, duration_ms, ...
    previous: DataFrame | None = None       # last snapshot (None = first run)
    existing: DataFrame | None = None       # enriched table: fingerprint, position, uri, ...
    cache: DataFrame | None = None          # match cache: fingerprint, matched, uri
    target: DataFrame | None = None         # target list: uri
    artists: DataFrame | None = None        # artist_id, genres
    features: DataFrame | None = None       # catalog_id + audio features
    listen: DataFrame | None = None         # artist, title, playcount, listeners, tags
    artist_id_col: str = "artist_id"
    catalog_index: object | None = None     # prebuilt CatalogIndex reused across runs (optional)
    progress: str | None = None             # folder of committed slices: a stopped run goes on where it was
    run_id: str = "run"                     # names the run there


class SyncPlan:
    """Named outputs of a run, each built on first use and then reused.

    Nothing is planned (let alone run) for an output nobody asks for, so a
    summary-only request never builds change-set batches or the enriched
    table."""

    def __init__(self):
        self._builders = {}
        self._built: dict[str, DataFrame] = {}

    def output(self, name: str):
        def deco(fn):
            self._builders[name] = fn
            return fn
        return deco

    def __getitem__(self, k: str) -> DataFrame:
        if k not in self._built:
            self._built[k] = self._builders[k]()
        return self._built[k]

    @property
    def names(self) -> list[str]:
        return [k for k in self._builders if not k.startswith("_")]

    @property
    def outputs(self) -> dict[str, DataFrame]:
        return {k: self[k] for k in self.names}


def plan_states(inp: SyncInputs, limit: int | None = None) -> DataFrame:
    """Per current row: already_matched / restored / known_unmatched / search / pending."""
    cur = inp.current
    if inp.existing is not None:
        split = C.split_existing(cur, inp.existing)
    else:
        split = cur.withColumn("state", F.lit(C.NEEDS)).withColumn("existing_uri", F.lit(""))
    none = {"cache_uri": F.lit(""), "cache_entry": C.no_entry()}
    done = split.where(F.col("state") == C.ALREADY).withColumns(none)
    needs = split.where(F.col("state") == C.NEEDS).drop("state")
    if inp.cache is not None:
        cs = C.cache_split(needs, inp.cache).drop("cache_matched")
    else:
        cs = needs.withColumn("state", F.lit(C.SEARCH)).withColumns(none)
    search = cs.where(F.col("state") == C.SEARCH).drop("state")
    rest = cs.where(F.col("state") != C.SEARCH)
    limited = C.limit_pending(search, limit)
    return done.unionByName(rest).unionByName(limited)


def plan_sync(inp: SyncInputs, cfg: MatchConfig | None = None, limit: int | None = None,
              run_ts: str = "1970-01-01T00:00:00", strict_parity: bool = False) -> SyncPlan:
    cfg = cfg or MatchConfig()
    plan = SyncPlan()

    @plan.output("diff")
    def _diff():
        return diff_snapshots(inp.current, inp.previous, "fingerprint", "position",
                              cols=[c for c in inp.current.columns if c != "fingerprint"])

    @plan.output("diff_summary")
    def _diff_summary():
        return diff_counts(plan["diff"])

    @plan.output("_states")
    def _states():
        return cut_lineage(plan_states(inp, limit), "sync-states")

    @plan.output("matches")
    def _matches():
        to_search = plan["_states"].where(F.col("state") == C.SEARCH)
        cat = inp.catalog_index if inp.catalog_index is not None else inp.catalog
        if inp.progress:
            resolve_in_slices(to_search, cat, inp.progress, inp.run_id, cfg=cfg)
            return resolved(to_search.sparkSession, inp.progress, inp.run_id).drop("fingerprint")
        return cut_lineage(match_waterfall(to_search, cat, cfg, id_col="position"), "sync-matches")

    @plan.output("states")
    def _final_states():
        newly = plan["matches"].where("matched").select("position", F.lit("newly_matched").alias("new_state"))
        return (plan["_states"].join(newly, "position", "left")
                .withColumn("state", F.when(F.col("state") == C.SEARCH, F.coalesce("new_state", F.lit("unmatched")))
                            .otherwise(F.col("state"))).drop("new_state"))

    @plan.output("_wanted")
    def _wanted():
        st = plan["states"]
        w = (st.select(F.when(F.col("state") == C.ALREADY, F.col("existing_uri"))
                       .when(F.col("state") == C.RESTORED, F.col("cache_uri")).alias("uri"))
               .unionByName(plan["matches"].where("matched").select("uri")))
        return w.where(F.coalesce(F.col("uri"), F.lit("")) != "")

    @plan.output("to_add")
    def _to_add():
        target = inp.target if inp.target is not None else plan["_wanted"].limit(0)
        return C.to_add(plan["_wanted"], target)

    @plan.output("to_remove")
    def _to_remove():
        if inp.previous is None or inp.existing is None:
            return plan["_wanted"].limit(0)
        removed = plan["diff"].where(F.col("change_type") == REMOVED)
        return C.to_remove(removed, inp.existing, plan["_wanted"], strict_parity=strict_parity)

    @plan.output("batches")
    def _batches():
        return C.change_batches(plan["to_add"], plan["to_remove"])

    @plan.output("summary")
    def _summary():
        return sync_summary(plan["states"])

    @plan.output("enriched")
    def _enriched():
        return enriched_union(inp, plan["states"], plan["matches"], run_ts)

    @plan.output("unmatched")
    def _unmatched():
        return plan["states"].where(F.col("state").isin("unmatched", "known_unmatched"))

    return plan


def enriched_union(inp: SyncInputs, states: DataFrame, matches: DataFrame, run_ts: str) -> DataFrame:
    """Enriched table of this run: already-resolved rows keep their enriched
    values, cache hits and new matches are applied to the current row,
    unresolved rows pass through; pending rows wait for a later run."""
    track_cols = [c for c, _ in N.TRACK_COLUMNS]
    keep = ["position", "fingerprint"]
    cur = N.with_track_defaults(states)
    parts = []
    if inp.existing is not None:
        ex = N.with_track_defaults(dedupe_last_wins(inp.existing, "fingerprint", "position")).drop("position")
        synced = blank("last_synced") if "last_synced" in states.columns else F.lit("")
        already = states.where(F.col("state") == C.ALREADY).select("position", "fingerprint", synced.alias("_synced"))
        parts.append(already.join(ex, "fingerprint")
                     .withColumn("last_synced", F.when(F.col("_synced") != "", F.col("_synced")).otherwise(F.col("last_synced")))
                     .select(*keep, *track_cols))
    restored = cur.where(F.col("state") == C.RESTORED)
    cached = restored.select("position", "cache_entry.*").withColumnRenamed("album_release_date", "release_date")
    parts.append(N.apply_match(restored, cached, "position", run_ts).select(*keep, *track_cols))
    newly = cur.where(F.col("state") == "newly_matched")
    parts.append(N.apply_match(newly, matches, "position", run_ts).select(*keep, *track_cols))
    parts.append(cur.where(F.col("state").isin("unmatched", "known_unmatched")).select(*keep, *track_cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nothing_to_do(inp: SyncInputs, limit: int | None = None) -> bool:
    """The gate of a sync run, asked before anything is planned: no current row is
    unresolved, none was removed, and no resolved row lacks what could be looked up.
    Each question ends at the first row that answers it."""
    if inp.existing is None or inp.previous is None:
        return False
    split = C.split_existing(inp.current, inp.existing)
    if split.where(F.col("state") == C.NEEDS).take(1):
        return False
    if inp.previous.join(inp.current.select("fingerprint"), "fingerprint", "left_anti").take(1):
        return False
    rows = N.with_track_defaults(inp.existing).join(inp.current.select("fingerprint").distinct(), "fingerprint", "left_semi")
    return not N.any_needs_enrichment(rows)


#: the tables of a published sync run
ENRICHED_CSV, UNMATCHED_CSV, SNAPSHOT, RESULTS, BATCHES = "enriched_csv", "unmatched_csv", "snapshot", "match_results", "batches"


def publish_sync(plan: SyncPlan, inp: SyncInputs, base: str, run_id: str, snapshot_ts: str,
                 dry_run: bool = False) -> Commit | None:
    """Write a sync run's outputs and commit them together; a dry run writes
    nothing, and a run that stops in between leaves the state before it.

    The tables: the 40-column and the 6-column export, the list state that the next
    run compares with, the match results (the next run's cache) and the write
    batches for the target.  Readers take them from ``Published(spark, base)``."""
    if dry_run:
        return None
    spark = inp.current.sparkSession
    store = Published(spark, base)
    if done := store.find(run_id):
        return done
    enriched = cut_lineage(enrich_all(cut_lineage(plan["enriched"], "sync-enriched"), inp), "sync-output")
    found = plan["matches"].join(plan["states"].select("position", "fingerprint"), "position")
    return store.publish(run_id, {
        ENRICHED_CSV: lambda p: csvio.write_enriched(enriched, p),
        UNMATCHED_CSV: lambda p: csvio.write_unmatched(enriched.where(F.col("uri") == ""), p),
        SNAPSHOT: lambda p: S.save_snapshot(inp.current, p, snapshot_ts),
        RESULTS: lambda p: K.write_match_results(found.withColumnRenamed("release_date", "album_release_date"), p, run_id),
        BATCHES: plan["batches"]}, {"snapshot_ts": snapshot_ts})


def sync_job(inp: SyncInputs, base: str, run_id: str, snapshot_ts: str, cfg: MatchConfig | None = None,
             limit: int | None = None, dry_run: bool = False) -> str:
    """A whole run.  Returns ``nothing new`` (the enriched export and the list
    state are still written), ``dry run`` or ``synced``.  No resolver job is run, and
    none is planned, where there is nothing to resolve."""
    if nothing_to_do(inp, limit):
        if not dry_run:
            rows = dedupe_last_wins(inp.existing, "fingerprint", "position").join(
                inp.current.select("fingerprint").distinct(), "fingerprint", "left_semi")
            Published(inp.current.sparkSession, base).publish(run_id, {
                ENRICHED_CSV: lambda p: csvio.write_enriched(N.with_track_defaults(rows), p),
                SNAPSHOT: lambda p: S.save_snapshot(inp.current, p, snapshot_ts)}, {"snapshot_ts": snapshot_ts})
        return "nothing new"
    plan = plan_sync(inp, cfg, limit, run_ts=snapshot_ts)
    publish_sync(plan, inp, base, run_id, snapshot_ts, dry_run)
    return "dry run" if dry_run else "synced"


def apply(plan: SyncPlan, base_path: str, names: list[str] | None = None) -> dict[str, str]:
    """Write the selected outputs as Parquet, committed together under
    ``base_path``; returns where they lie."""
    names = names or plan.names
    store = Published(plan[names[0]].sparkSession, base_path)
    return dict(store.publish("plan", {k: plan[k] for k in names}).tables)


def enrich_all(tracks: DataFrame, inp: SyncInputs) -> DataFrame:
    """Metadata, genres, audio features and listen statistics."""
    return N.enrich(tracks, inp.catalog, inp.artists, inp.features, inp.listen, inp.artist_id_col)
