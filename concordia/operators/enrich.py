"""Enrichment: apply resolver results and fill lookups by joins.

A backfill is a *step*: which rows need it, the key they look up, and what a hit
sets.  Steps of one key are one lookup (``look_up``): their tables are brought
together by key first, and the tracks are joined once.  Rows that need none of them
get a key of their own that matches nothing, so they are spread over all tasks
instead of meeting in the NULL key's.  A lookup table is cut down to the ids that
are asked for before its repeated keys are reduced to one row, so a small list never
regroups a whole catalogue.  Every track sharing a catalogue id or (artist, title)
gets the values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.config import MAX_TAGS
from concordia.functions.text import blank, first_artist, is_missing, join_list, uri_id
from concordia.schema import AUDIO_FEATURES, FEATURE_DEFAULTS, TRACK_COLUMNS, TRACK_DEFAULTS

MATCH_FIELDS = {  # track column <- match result column
    "uri": "uri", "catalog_url": "url", "duration_ms": "duration_ms", "explicit": "explicit",
    "release_date": "release_date", "popularity": "popularity", "album_type": "album_type",
    "track_number": "track_number", "match_method": "method", "match_confidence": "confidence",
}


def lookup_by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Bulk lookup: rows of ``table`` whose ``key`` is among ``ids`` (a semi
    join on the distinct ids; absent ids simply give no row)."""
    return table.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def with_track_defaults(df: DataFrame) -> DataFrame:
    """Add any missing track column with its sentinel and cast to its type."""
    out = []
    present = set(df.columns)
    for c, t in TRACK_COLUMNS:
        out.append((F.col(c) if c in present else F.lit(TRACK_DEFAULTS[c])).cast(t).alias(c))
    extra = [c for c in df.columns if c not in dict(TRACK_COLUMNS)]
    return df.select(*extra, *out)


def matched(c: str = "uri") -> Column:
    return blank(c) != ""


def apply_match(tracks: DataFrame, matches: DataFrame, key: str, run_ts: str) -> DataFrame:
    """Overwrite the catalogue fields of rows with a resolved match, stamp
    ``last_synced`` (and ``first_synced`` when blank), fill ``isrc`` only when
    blank.  ``matches``: one row per key with match result columns."""
    m = matches.where(F.coalesce(F.col("uri"), F.lit("")) != "")
    cols = {v: F.col(v).alias(f"_m_{v}") for v in set(MATCH_FIELDS.values()) | {"isrc"} if v in m.columns}
    m = m.select(key, *cols.values())
    j = tracks.join(m, key, "left")
    hit = F.col("_m_uri").isNotNull()
    ts = F.lit(run_ts)
    sets = {}
    for tc, mc in MATCH_FIELDS.items():
        if mc in cols:
            sets[tc] = F.when(hit, F.col(f"_m_{mc}")).otherwise(F.col(tc))
    sets["last_synced"] = F.when(hit, ts).otherwise(F.col("last_synced"))
    sets["first_synced"] = F.when(hit & (blank("first_synced") == ""), ts).otherwise(F.col("first_synced"))
    if "isrc" in cols:
        sets["isrc"] = F.when(hit & (blank("isrc") == "") & (blank("_m_isrc") != ""), F.col("_m_isrc")) \
                        .otherwise(F.col("isrc"))
    return j.withColumns(sets).drop(*[f"_m_{v}" for v in cols])


def _one_per_key(lookup: DataFrame, keys: list[str]) -> DataFrame:
    """The row of greatest values of each key (partial maxima before the shuffle)."""
    rest = [c for c in lookup.columns if c not in keys]
    return (lookup.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_one"))
            .select(*[F.col(c) if c in keys else F.col(f"_one.{c}").alias(c) for c in lookup.columns]))


@dataclass(frozen=True)
class Step:
    """One backfill: ``need`` of a track; ``sets(hit, row)`` gives the new columns
    from the struct ``row`` that the table ``name`` holds for the track's key."""
    name: str
    need: Column
    sets: Callable[[Column, Column], dict[str, Column]]
    table: str = ""     # the table it looks up, if that is not called like the step


def look_up(tracks: DataFrame, keys: dict[str, Column], tables: dict[str, DataFrame], steps: list[Step]) -> DataFrame:
    """Apply ``steps`` that share the lookup key ``keys`` (name to expression over
    the tracks).  ``tables`` hold the key columns and are reduced to one row a key;
    each is read once, the tracks twice (their keys, then the join)."""
    names = list(keys)
    t = tracks.withColumns({f"_need_{s.name}": F.coalesce(s.need, F.lit(False)) for s in steps})
    some = F.lit(False)
    for s in steps:
        some = some | F.col(f"_need_{s.name}")
    asked = t.where(some).select(*(e.alias(k) for k, e in keys.items())).distinct()
    found = None
    for name, table in tables.items():
        one = _one_per_key(table.join(asked, names, "left_semi"), names)
        one = one.select(*names, F.struct(*[c for c in table.columns if c not in names]).alias(name))
        found = one if found is None else found.join(one, names, "full_outer")
    found = found.select(*(F.col(k).alias(f"_k_{k}") for k in names), *(F.col(n).alias(f"_row_{n}") for n in tables))
    # a key that nothing has, different for every row
    nothing = F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))
    t = t.withColumns({f"_key_{k}": F.when(some, e).otherwise(nothing) for k, e in keys.items()})
    on = F.lit(True)
    for k in names:
        on = on & (F.col(f"_key_{k}") == F.col(f"_k_{k}"))
    j = t.join(found, on, "left")
    new: dict[str, Column] = {}
    for s in steps:
        row = F.col(f"_row_{s.table or s.name}")
        for c, value in s.sets(F.col(f"_need_{s.name}") & row.isNotNull(), row).items():
            new[c] = F.when(F.col(f"_need_{s.name}"), value).otherwise(F.col(c))
    return j.withColumns(new).select(*tracks.columns)


def _metadata_step() -> Step:
    """Matched rows missing duration, isrc or popularity take catalogue
    values: duration/explicit/popularity/track number always (absent ->
    default), release date / album type when present, isrc only if blank."""
    need = matched() & (is_missing("duration_ms", 0) | (blank("isrc") == "") | is_missing("popularity", 0))

    def sets(hit, row):
        def always(c, default):
            return F.when(hit, F.coalesce(row[c], F.lit(default))).otherwise(F.col(c))

        def present(c, also=F.lit(True)):
            return F.when(hit & also & (blank(row[c]) != ""), row[c]).otherwise(F.col(c))
        return {"duration_ms": always("duration_ms", 0), "explicit": always("explicit", False),
                "popularity": always("popularity", 0), "track_number": always("track_number", 0),
                "release_date": present("release_date"), "album_type": present("album_type"),
                "isrc": present("isrc", blank("isrc") == "")}
    return Step("catalog", need, sets)


CATALOG_FIELDS = ["duration_ms", "explicit", "popularity", "track_number", "release_date", "album_type", "isrc"]


def _genres_step() -> Step:
    """Matched rows without genres: catalogue row -> primary artist -> genres."""
    return Step("genres", matched() & (blank("artist_genres") == ""), lambda hit, row: {
        "artist_genres": F.when(hit, row["genre_text"]).otherwise(F.col("artist_genres"))})


def _genres_table(catalog: DataFrame, artists: DataFrame, artist_id_col: str) -> DataFrame:
    """catalog_id -> the genres of its primary artist, as text."""
    genres = _one_per_key(artists.select(F.col("artist_id").alias("_aid"), "genres"), ["_aid"])
    return (catalog.select("catalog_id", F.col(artist_id_col).alias("_aid")).join(genres, "_aid")
            .select("catalog_id", join_list("genres").alias("genre_text")))


def _features_step() -> Step:
    """Matched rows not yet attempted take features (absent -> defaults) and
    are all flagged attempted, hit or not."""
    def sets(hit, row):
        out = {}
        for c in AUDIO_FEATURES:
            t = dict(TRACK_COLUMNS)[c]
            out[c] = F.when(hit, F.coalesce(row[c].cast(t), F.lit(FEATURE_DEFAULTS[c]).cast(t))).otherwise(F.col(c))
        return {**out, "audio_features_fetched": F.lit(True)}
    return Step("features", matched() & ~F.coalesce(F.col("audio_features_fetched"), F.lit(False)), sets)


def backfill_metadata(tracks: DataFrame, catalog: DataFrame) -> DataFrame:
    return enrich(tracks, catalog=catalog)


def backfill_genres(tracks: DataFrame, catalog: DataFrame, artists: DataFrame,
                    artist_id_col: str = "artist_id") -> DataFrame:
    return look_up(tracks, {"catalog_id": uri_id("uri")}, {"genres": _genres_table(catalog, artists, artist_id_col)},
                   [_genres_step()])


def audio_features(tracks: DataFrame, features: DataFrame) -> DataFrame:
    return look_up(tracks, {"catalog_id": uri_id("uri")}, {"features": features.select("catalog_id", *AUDIO_FEATURES)},
                   [_features_step()])


def listen_stats(tracks: DataFrame, stats: DataFrame, max_tags: int = MAX_TAGS, ignore_case: bool = False) -> DataFrame:
    """Rows without listen counts take them by (first artist, title); tags
    are the first ``max_tags`` names joined with ', '.  With ``ignore_case`` both
    sides are compared in lower case."""
    need = is_missing("playcount", 0) & (blank("title") != "") & (blank("artist") != "") & \
        (first_artist("artist") != "")
    fold = F.lower if ignore_case else (lambda c: c)
    stats = stats.select(fold(F.col("artist")).alias("l_artist"), fold(F.col("title")).alias("l_title"),
                         F.col("playcount").cast("long").alias("playcount"), F.col("listeners").cast("long").alias("listeners"), "tags")

    def sets(hit, row):
        def count(c):
            return F.when(hit, F.coalesce(row[c], F.lit(0).cast("long"))).otherwise(F.col(c))
        return {"playcount": count("playcount"), "listeners": count("listeners"),
                "tags": F.when(hit, join_list(F.slice(F.coalesce(row["tags"], F.array()), 1, max_tags))).otherwise(F.col("tags"))}
    return look_up(tracks, {"l_artist": fold(first_artist("artist")), "l_title": fold(F.col("title"))}, {"listen": stats},
                   [Step("listen", need, sets)])


def enrich(tracks: DataFrame, catalog: DataFrame | None = None, artists: DataFrame | None = None,
           features: DataFrame | None = None, listen: DataFrame | None = None,
           artist_id_col: str = "artist_id") -> DataFrame:
    """Metadata, genres, audio features and listen statistics, as far as their
    tables are given: one lookup by catalogue id for the first three, one by
    (first artist, title) for the last.

    The catalogue is read once: its row of an id serves the metadata and, through
    its primary artist, the genres (an id that it holds twice counts once)."""
    tables, steps = {}, []
    if catalog is not None:
        fields = CATALOG_FIELDS + ([] if artists is None else ["genre_text"])
        if artists is not None:
            genres = _one_per_key(artists.select(F.col("artist_id").alias("_aid"), "genres"), ["_aid"])
            catalog = (catalog.withColumn("_aid", F.col(artist_id_col)).join(genres, "_aid", "left")
                       .withColumn("genre_text", F.when(F.col("genres").isNotNull(), join_list("genres"))))
        tables["catalog"] = catalog.select("catalog_id", *fields)
        steps.append(_metadata_step())
        if artists is not None:
            s = _genres_step()
            steps.append(Step("genres", s.need, lambda hit, row: s.sets(hit & row["genre_text"].isNotNull(), row), "catalog"))
    if features is not None:
        tables["features"] = features.select("catalog_id", *AUDIO_FEATURES)
        steps.append(_features_step())
    out = look_up(tracks, {"catalog_id": uri_id("uri")}, tables, steps) if steps else tracks
    return out if listen is None else listen_stats(out, listen)


def needs_enrichment(tracks: DataFrame) -> DataFrame:
    """One row: does any resolved row still miss popularity, genres or listen
    counts, and how many."""
    cond = matched() & (is_missing("popularity", 0) | (blank("artist_genres") == "") | is_missing("playcount", 0))
    return tracks.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias("needs_enrichment"),
                      F.count_if(cond).alias("n_needing"))


def any_needs_enrichment(tracks: DataFrame) -> bool:
    """Early-exit probe: stops at the first qualifying row."""
    cond = matched() & (is_missing("popularity", 0) | (blank("artist_genres") == "") | is_missing("playcount", 0))
    return len(tracks.where(cond).limit(1).take(1)) > 0
