"""Three-pass resolver of source items against a catalogue.

Pass 1 (``isrc``): exact id equi-join; the catalogue is reduced to its first
row per id (rank order) first.  Confidence = score clamped to [0.95, 1].
Pass 2 (``title_artist``): candidates must hold every title token in their
name and every first-artist token in their artist; score plus a 0.1 bonus
for a close duration (capped at 1) must reach 0.5.
Pass 3 (``relaxed``): title tokens only; raw score must reach 0.4.
The waterfall runs a pass only on rows the earlier passes left.

Work is done per distinct query, scoring probe and class of catalogue rows
(``operators.classes``), and the Python similarity helper sees each distinct string
pair once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.config import (METHOD_ISRC, METHOD_RELAXED, METHOD_TITLE_ARTIST, MatchConfig)
from concordia.functions.similarity import pair_similarity, ratio_upper_bound
from concordia.functions.text import blank, duration_close, first_artist, normalize_text, tokens
from concordia.operators.candidates import candidates, field_keys, postings
from concordia.operators.classes import CatalogClasses, bounded_best, build_classes
from concordia.session import cut_lineage, spread

# Catalogue columns carried into a match result (those present are kept).
RESULT_FIELDS = ["catalog_id", "uri", "url", "isrc", "duration_ms", "explicit", "release_date",
                 "popularity", "album_type", "track_number", "artist_id"]
_SRC = ["s_title", "s_first_artist", "s_artist", "s_duration"]
CELL = 2048             # candidates, and durations, of a text that meet in one cell
TASK_ROWS = 2_000_000   # scored rows that a task makes


def prepare_source(src: DataFrame, id_col: str, title="title", artist="artist",
                   duration="duration", isrc="isrc") -> DataFrame:
    """Normalised matching columns of the source rows, in one pass over evenly dealt rows."""
    cols = src.columns
    return spread(src.select(*dict.fromkeys(c for c in (id_col, title, artist, duration, isrc) if c in cols))).select(
        F.col(id_col).alias("_id"),
        normalize_text(title).alias("s_title"),
        normalize_text(first_artist(artist)).alias("s_first_artist"),
        normalize_text(artist).alias("s_artist"),
        (F.coalesce(F.col(duration).cast("double"), F.lit(0.0)) if duration in cols else F.lit(0.0)).alias("s_duration"),
        (blank(isrc) if isrc in cols else F.lit("")).alias("s_isrc"),
    )


def prepare_catalog(cat: DataFrame, name="name", artist="artist") -> DataFrame:
    """Normalised catalogue with title / artist token keys (the search index)."""
    keep = [c for c in RESULT_FIELDS if c in cat.columns]
    nc = spread(cat.select(*dict.fromkeys([*keep, name, artist]))).select(
        *keep, normalize_text(name).alias("c_name"), normalize_text(artist).alias("c_artist"))
    return nc.select(
        "*",
        F.concat(field_keys("t:", tokens("c_name")), field_keys("a:", tokens("c_artist"))).alias("k_all"),
    )


@dataclass
class CatalogIndex:
    """Everything the resolver derives from the catalogue alone: normalised
    rows, first row per id, scoring classes with their postings and key
    frequencies.  Build it once per catalogue version (``build_catalog_index``)
    and reuse it for every run, so a sync over a small list never re-reads the
    whole catalogue."""
    index: DataFrame
    first: DataFrame
    classes: CatalogClasses


def build_catalog_index(catalog: DataFrame, cfg: MatchConfig | None = None,
                        base: str | None = None) -> CatalogIndex:
    """Normalise the catalogue and derive its search structures.  With
    ``base`` (a path on shared storage) the parts are written there and read
    back, so later runs can ``load_catalog_index(base)`` instead."""
    cfg = cfg or MatchConfig()
    index = cut_lineage(prepare_catalog(catalog), "catalog-index")
    first = cut_lineage(first_by_isrc(index), "catalog-first")
    ci = CatalogIndex(index, first, build_classes(index, _fields(index), cfg))
    if base is not None:
        spark = catalog.sparkSession
        parts = {"index": index, "first": first} | {n: getattr(ci.classes, n) for n in CatalogClasses.PARTS}
        for name, part in parts.items():
            part.write.mode("errorifexists").parquet(f"{base}/{name}")
        ci = load_catalog_index(spark, base, ci.classes.has_pairs)
    return ci


def load_catalog_index(spark, base: str, has_pairs: bool = True) -> CatalogIndex:
    parts = {n: spark.read.parquet(f"{base}/{n}") for n in ("index", "first", *CatalogClasses.PARTS)}
    return CatalogIndex(parts["index"], parts["first"], CatalogClasses(*(parts[n] for n in CatalogClasses.PARTS), has_pairs))


def _fields(index: DataFrame) -> list[str]:
    return [c for c in RESULT_FIELDS if c in index.columns]


def _score(rows: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Add title/artist similarity (per distinct pair) and the weighted score."""
    ts = pair_similarity(rows, "s_title", "c_name", "title_sim", cfg.metric)
    as_ = pair_similarity(rows, "s_artist", "c_artist", "artist_sim", cfg.metric)
    r = rows.join(ts, ["s_title", "c_name"]).join(as_, ["s_artist", "c_artist"])
    return r.withColumn("score", _weighted(cfg))


def _weighted(cfg: MatchConfig) -> Column:
    dur = F.when(F.col("dur_close"), F.lit(1.0)).otherwise(F.lit(cfg.duration_miss_factor))
    return (F.col("title_sim") * F.lit(cfg.w_title) + F.col("artist_sim") * F.lit(cfg.w_artist)
            + dur * F.lit(cfg.w_duration))


def _with_close(rows: DataFrame, cfg: MatchConfig) -> DataFrame:
    return rows.withColumn("dur_close", duration_close("s_duration", "duration_ms", cfg.duration_tolerance_sec))


def _bound_filter(rows: DataFrame, cfg: MatchConfig, bonus: bool, threshold: float) -> DataFrame:
    """Lossless prune: drop candidates that cannot reach ``threshold``."""
    if not cfg.prune_by_length_bound or cfg.metric != "ratio":
        return rows
    dur = F.when(F.col("dur_close"), F.lit(1.0)).otherwise(F.lit(cfg.duration_miss_factor))
    ub = (ratio_upper_bound(F.col("s_title"), F.col("c_name")) * F.lit(cfg.w_title)
          + ratio_upper_bound(F.col("s_artist"), F.col("c_artist")) * F.lit(cfg.w_artist)
          + dur * F.lit(cfg.w_duration))
    if bonus:
        ub = ub + F.when(F.col("dur_close"), F.lit(cfg.pass2_bonus)).otherwise(F.lit(0.0))
    # small slack keeps the bound safe against float rounding
    return rows.where(ub >= F.lit(threshold - 1e-9))


def first_by_isrc(index: DataFrame) -> DataFrame:
    """The catalogue row an exact-id search returns: rank 1 per id (a top-1
    window, limited per map task before the shuffle)."""
    w = Window.partitionBy("isrc").orderBy(F.col("popularity").desc(), F.col("uri").asc())
    return (index.where(F.col("isrc") != "")
                 .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r"))


def match_isrc(prepared: DataFrame, index: DataFrame, cfg: MatchConfig,
               first: DataFrame | None = None) -> DataFrame:
    """Pass 1: one row per matched source row: _id, result fields, method, confidence."""
    fields = _fields(index)
    first = first if first is not None else first_by_isrc(index)
    rows = (prepared.where(F.col("s_isrc") != "")
                    .join(first, prepared.s_isrc == first.isrc)
                    .where(F.col("uri") != ""))
    # written once: both similarity branches and the scoring join read it
    rows = _score(cut_lineage(_with_close(rows, cfg), "isrc-rows"), cfg)
    conf = F.least(F.greatest(F.col("score"), F.lit(cfg.isrc_conf_floor)), F.lit(1.0))
    return rows.select("_id", *fields, F.lit(METHOD_ISRC).alias("method"), conf.alias("confidence"))


def build_postings(index: DataFrame, cfg: MatchConfig):
    """Postings over title and artist keys; they serve both fuzzy passes (a
    title-only query holds only title keys, so containment in the full key
    set is containment in the title keys)."""
    return postings(index, "k_all", _fields(index) + ["c_name", "c_artist"], cfg)


def _asked(prepared: DataFrame, with_artist: bool) -> tuple[DataFrame, list[str], Column]:
    """(rows that can be searched for, columns of their query, its keys)."""
    if with_artist:
        src = prepared.where((F.col("s_title") != "") | (F.col("s_first_artist") != ""))
        return src, ["s_title", "s_first_artist"], F.array_distinct(
            F.concat(field_keys("t:", tokens("s_title")), field_keys("a:", tokens("s_first_artist"))))
    return prepared.where(F.col("s_title") != ""), ["s_title"], field_keys("t:", tokens("s_title"))


def search_candidates(prepared: DataFrame, index: DataFrame, cfg: MatchConfig,
                      with_artist: bool, built=None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Top-k candidates per distinct query of the prepared rows.

    Returns (candidates, eligible source rows, query columns)."""
    item_cols = _fields(index) + ["c_name", "c_artist"]
    src, qcols, qkeys = _asked(prepared, with_artist)
    queries = src.select(*qcols).distinct().withColumn("q_keys", qkeys)
    cands = candidates(queries, qcols, "q_keys", index, "k_all", item_cols, cfg, cfg.max_candidates,
                       built=built or (build_postings(index, cfg) if cfg.max_candidates else None))
    return cands, src, qcols


def score_candidates(prepared: DataFrame, index: DataFrame, cfg: MatchConfig,
                     with_artist: bool, prune_threshold: float | None = None, built=None) -> DataFrame:
    """All top-k candidates of each distinct probe, scored.

    Returns probe columns + result fields + rank, score, eff (pass-2 score).  The rows
    are a product by nature (durations asked for x candidates of a text), so all that is
    dear is done before it: similarities are joined to the candidates of a text, and the
    product itself is neither written nor shuffled.  It is dealt in cells of at most
    ``CELL`` ranks x about ``CELL`` durations of a text, over tasks of about ``TASK_ROWS`` rows."""
    cands, src, qcols = search_candidates(prepared, index, cfg, with_artist, built)
    probes = cut_lineage(src.select(*_SRC).distinct(), "probes")
    texts = [c for c in _SRC if c != "s_duration"]
    of_text = probes.groupBy(*texts).agg(F.count(F.lit(1)).alias("nd"))
    of_query = cands.groupBy(*qcols).agg(F.count(F.lit(1)).alias("nc"), F.max("rank").alias("last"))

    def parts(n: str) -> Column:
        return F.ceil(F.col(n) / F.lit(CELL)).cast("int")
    cells = cut_lineage(of_text.join(of_query, qcols).select(
        *texts, parts("last").alias("np"), parts("nd").alias("nq"), (F.col("nc") * F.col("nd")).alias("rows")), "probe-cells")
    tasks = -(-(cells.agg(F.sum("rows")).first()[0] or 1) // TASK_ROWS)
    key = [*texts, "p", "q"]
    ts = pair_similarity(cells.select(*texts).join(cands.select(*qcols, "c_name").distinct(), qcols),
                         "s_title", "c_name", "title_sim", cfg.metric)
    as_ = pair_similarity(cells.select(*texts).join(cands.select(*qcols, "c_artist").distinct(), qcols),
                          "s_artist", "c_artist", "artist_sim", cfg.metric)
    of_cell = (cells.select(*texts, "nq").join(cands, qcols).join(ts, ["s_title", "c_name"]).join(as_, ["s_artist", "c_artist"])
               .withColumn("p", F.floor((F.col("rank") - 1) / F.lit(CELL)).cast("int"))
               .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq"))
    asked = (probes.join(cells.select(*texts, "np", "nq"), texts)
             .withColumn("q", F.pmod(F.xxhash64("s_duration"), F.col("nq").cast("long")).cast("int"))
             .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("np") - 1))).drop("np", "nq"))
    rows = _with_close(of_cell.repartition(tasks, *key).join(asked.repartition(tasks, *key), key).drop("p", "q"), cfg)
    if prune_threshold is not None:
        rows = _bound_filter(rows, cfg, with_artist, prune_threshold)
    rows = rows.withColumn("score", _weighted(cfg))
    eff = F.least(F.col("score") + F.when(F.col("dur_close"), F.lit(cfg.pass2_bonus)).otherwise(F.lit(0.0)),
                  F.lit(1.0))
    return rows.withColumn("eff", eff)


def match_fuzzy(prepared: DataFrame, index: DataFrame, cfg: MatchConfig, with_artist: bool,
                classes: CatalogClasses | None = None, work: dict | None = None) -> DataFrame:
    """Pass 2 (``with_artist``) or pass 3 on the given rows: one row per matched _id.

    The arg-max of a probe is its highest score, the earliest rank on ties; it
    counts if it reaches the pass's threshold."""
    thr = cfg.pass2_threshold if with_artist else cfg.pass3_threshold
    src, qcols, qkeys = _asked(prepared, with_artist)
    best = bounded_best(src, qcols, qkeys, classes or build_classes(index, _fields(index), cfg), cfg, thr,
                        cfg.pass2_bonus if with_artist else 0.0, _SRC, work)
    best = cut_lineage(best.select(*_SRC, "row.*", F.col("score").alias("confidence"))
                       .where((F.col("confidence") >= F.lit(thr)) & (F.col("uri") != "")), "pass-best")
    method = F.lit(METHOD_TITLE_ARTIST if with_artist else METHOD_RELAXED).alias("method")
    return prepared.join(best, _SRC).select("_id", *_fields(index), method, "confidence")


def _unmatched(rows: DataFrame, fields: list[str], index: DataFrame) -> DataFrame:
    types = dict(index.dtypes)
    out = [F.col("_id")]
    for f in fields:
        t = types[f]
        d = F.lit("") if t == "string" else F.lit(False) if t == "boolean" else F.lit(0).cast(t)
        out.append(d.alias(f))
    return rows.select(*out, F.lit("").alias("method"), F.lit(0.0).alias("confidence"))


def match_waterfall(src: DataFrame, catalog: DataFrame | CatalogIndex, cfg: MatchConfig | None = None,
                    id_col: str = "position", passes=("isrc", "title_artist", "relaxed"),
                    **src_cols) -> DataFrame:
    """Resolve every source row: the first pass that matches wins.

    Returns one row per source row: ``id_col``, result fields, method ('' when
    unmatched), confidence, matched.  Each pass's per-probe winners are written
    to the shared checkpoint folder, so the residual of the next pass does not
    re-run the earlier passes.  ``catalog`` may be a raw catalogue table or a
    prebuilt ``CatalogIndex`` (reused across runs).
    """
    cfg = cfg or MatchConfig()
    prepared = cut_lineage(prepare_source(src, id_col, **src_cols), "prepared")
    ci = catalog if isinstance(catalog, CatalogIndex) else None
    index = ci.index if ci else cut_lineage(prepare_catalog(catalog), "catalog-index")
    fields = _fields(index)
    results = []
    rest = prepared
    classes = ci.classes if ci else None
    for p in passes:
        if p != "isrc" and classes is None:
            classes = build_classes(index, fields, cfg)
        if p == "isrc":
            hit = cut_lineage(match_isrc(rest, index, cfg, ci.first if ci else None), "pass-isrc")
        elif p == "title_artist":
            hit = match_fuzzy(rest, index, cfg, with_artist=True, classes=classes)
        elif p == "relaxed":
            hit = match_fuzzy(rest, index, cfg, with_artist=False, classes=classes)
        else:
            raise ValueError(p)
        results.append(hit)
        rest = rest.join(hit.select("_id"), "_id", "left_anti")
    results.append(_unmatched(rest, fields, index))
    out = reduce(lambda a, b: a.unionByName(b), results)
    return out.select(F.col("_id").alias(id_col), *fields, "method", "confidence",
                      (F.col("method") != "").alias("matched"))


def match_single_pass(src: DataFrame, catalog: DataFrame, pass_name: str, cfg: MatchConfig | None = None,
                      id_col: str = "position", **src_cols) -> DataFrame:
    """One pass on every source row (no waterfall): matched rows only."""
    cfg = cfg or MatchConfig()
    prepared = cut_lineage(prepare_source(src, id_col, **src_cols), "prepared")
    index = cut_lineage(prepare_catalog(catalog), "catalog-index")
    if pass_name == "isrc":
        hit = match_isrc(prepared, index, cfg)
    else:
        hit = match_fuzzy(prepared, index, cfg, with_artist=(pass_name == "title_artist"))
    return hit.withColumnRenamed("_id", id_col)


def method_label(c: Column | str = "method") -> Column:
    """Blank method -> 'unknown' (report label)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))
