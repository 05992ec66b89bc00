"""Schemas, sentinels and the export column order."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The enriched export has exactly these 40 columns, in this
# order (names and order are part of the file format users already have).
# ---------------------------------------------------------------------------
ENRICHED_COLUMNS = [
    "title", "artist", "album", "isrc", "platform", "trackId",
    "duration", "addedDate", "addedBy", "url",
    "spotify_uri", "spotify_url", "spotify_duration_ms",
    "isrc_enriched", "explicit", "album_release_date",
    "danceability", "energy", "valence", "tempo",
    "key", "mode", "loudness", "speechiness",
    "acousticness", "instrumentalness", "liveness", "time_signature",
    "audio_features_fetched",
    "popularity", "artist_genres", "album_type", "track_number",
    "lastfm_playcount", "lastfm_listeners", "lastfm_tags",
    "match_method", "match_confidence", "first_synced", "last_synced",
]

# The unmatched export columns, in order.
UNMATCHED_COLUMNS = ["title", "artist", "album", "trackId", "url", "platform"]

# The snapshot keeps these track fields.
SNAPSHOT_TRACK_FIELDS = ["trackId", "title", "artist", "album", "duration"]

# Audio feature names; key and mode default to -1, others to 0.
AUDIO_FEATURES = [
    "danceability", "energy", "valence", "tempo", "key", "mode", "loudness",
    "speechiness", "acousticness", "instrumentalness", "liveness", "time_signature",
]
INT_FEATURES = {"key", "mode", "time_signature"}
FEATURE_DEFAULTS = {f: (-1 if f in ("key", "mode") else 0) for f in AUDIO_FEATURES}

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

# Typed columns (export names) and their Spark type; all others are strings.
TYPED_EXPORT = {
    "duration": _D, "spotify_duration_ms": _I, "explicit": _B,
    "danceability": _D, "energy": _D, "valence": _D, "tempo": _D,
    "key": _I, "mode": _I, "loudness": _D, "speechiness": _D,
    "acousticness": _D, "instrumentalness": _D, "liveness": _D,
    "time_signature": _I, "audio_features_fetched": _B,
    "popularity": _I, "track_number": _I,
    "lastfm_playcount": _L, "lastfm_listeners": _L, "match_confidence": _D,
}

# Missing-value sentinel per typed export column (empty text -> sentinel).
SENTINELS = {c: (False if t == _B else 0.0 if t == _D else 0) for c, t in TYPED_EXPORT.items()}
SENTINELS["key"] = -1
SENTINELS["mode"] = -1

ENRICHED_STRING_SCHEMA = T.StructType([T.StructField(c, _S, True) for c in ENRICHED_COLUMNS])
UNMATCHED_STRING_SCHEMA = T.StructType([T.StructField(c, _S, True) for c in UNMATCHED_COLUMNS])

ENRICHED_TYPED_SCHEMA = T.StructType(
    [T.StructField(c, TYPED_EXPORT.get(c, _S), False) for c in ENRICHED_COLUMNS])

SNAPSHOT_TRACK = T.StructType([
    T.StructField("trackId", _S), T.StructField("title", _S), T.StructField("artist", _S),
    T.StructField("album", _S), T.StructField("duration", _D),
])
# Legacy JSON snapshot document.
SNAPSHOT_DOC = T.StructType([
    T.StructField("timestamp", _S), T.StructField("track_count", _L),
    T.StructField("tracks", T.ArrayType(SNAPSHOT_TRACK)),
])

# Source playlist page payload (one row per page of items).
ARTIST_REF = T.StructType([T.StructField("name", _S), T.StructField("id", _S)])
PLAYLIST_ITEM = T.StructType([
    T.StructField("title", _S), T.StructField("videoId", _S), T.StructField("isrc", _S),
    T.StructField("duration", _S), T.StructField("duration_seconds", _S),
    T.StructField("artists", T.ArrayType(ARTIST_REF)),
    T.StructField("album", T.StructType([T.StructField("name", _S)])),
])
PLAYLIST_PAGE = T.StructType([
    T.StructField("playlist_id", _S), T.StructField("page", _L),
    T.StructField("tracks", T.ArrayType(PLAYLIST_ITEM)),
])

# Listen-statistics payload (one row per looked-up (artist, title)).
LISTEN_PAYLOAD = T.StructType([
    T.StructField("lookup_artist", _S), T.StructField("lookup_title", _S),
    T.StructField("error", _L), T.StructField("message", _S),
    T.StructField("track", T.StructType([
        T.StructField("playcount", _S), T.StructField("listeners", _S),
        T.StructField("toptags", T.StructType([
            T.StructField("tag", T.ArrayType(T.StructType([T.StructField("name", _S)]))),
        ])),
    ])),
])

# Match-result (cache) table.
MATCH_RESULT = T.StructType([
    T.StructField("fingerprint", _S, False), T.StructField("matched", _B, False),
    T.StructField("uri", _S), T.StructField("url", _S), T.StructField("method", _S),
    T.StructField("confidence", _D), T.StructField("isrc", _S), T.StructField("explicit", _B),
    T.StructField("album_release_date", _S), T.StructField("duration_ms", _I),
    T.StructField("popularity", _I), T.StructField("album_type", _S),
    T.StructField("track_number", _I),
])


# Internal typed track table (snake_case, neutral names).  Export edge maps
# these to ENRICHED_COLUMNS; ``isrc_enriched`` is a copy of ``isrc``.
TRACK_COLUMNS: list[tuple[str, T.DataType]] = [
    ("title", _S), ("artist", _S), ("album", _S), ("isrc", _S), ("platform", _S), ("track_id", _S),
    ("duration", _D), ("added_date", _S), ("added_by", _S), ("url", _S),
    ("uri", _S), ("catalog_url", _S), ("duration_ms", _I), ("explicit", _B), ("release_date", _S),
    ("danceability", _D), ("energy", _D), ("valence", _D), ("tempo", _D), ("key", _I), ("mode", _I),
    ("loudness", _D), ("speechiness", _D), ("acousticness", _D), ("instrumentalness", _D),
    ("liveness", _D), ("time_signature", _I), ("audio_features_fetched", _B),
    ("popularity", _I), ("artist_genres", _S), ("album_type", _S), ("track_number", _I),
    ("playcount", _L), ("listeners", _L), ("tags", _S),
    ("match_method", _S), ("match_confidence", _D), ("first_synced", _S), ("last_synced", _S),
]
TRACK_TYPES = dict(TRACK_COLUMNS)
TRACK_DEFAULTS = {c: ("" if t == _S else False if t == _B else 0.0 if t == _D else 0) for c, t in TRACK_COLUMNS}
TRACK_DEFAULTS["key"] = -1
TRACK_DEFAULTS["mode"] = -1

# internal name -> export name (others keep their name)
INTERNAL_TO_EXPORT = {
    "track_id": "trackId", "added_date": "addedDate", "added_by": "addedBy",
    "uri": "spotify_uri", "catalog_url": "spotify_url", "duration_ms": "spotify_duration_ms",
    "release_date": "album_release_date", "playcount": "lastfm_playcount",
    "listeners": "lastfm_listeners", "tags": "lastfm_tags",
}
EXPORT_TO_INTERNAL = {v: k for k, v in INTERNAL_TO_EXPORT.items()}

# Catalogue track payload (one JSON object per track).
CATALOG_TRACK = T.StructType([
    T.StructField("id", _S), T.StructField("uri", _S), T.StructField("name", _S),
    T.StructField("duration_ms", _I), T.StructField("explicit", _B), T.StructField("popularity", _I),
    T.StructField("track_number", _I),
    T.StructField("external_ids", T.StructType([T.StructField("isrc", _S)])),
    T.StructField("external_urls", T.StructType([T.StructField("spotify", _S)])),
    T.StructField("album", T.StructType([T.StructField("release_date", _S), T.StructField("album_type", _S)])),
    T.StructField("artists", T.ArrayType(ARTIST_REF)),
])
# Target list page: items whose track may be null.
TARGET_PAGE = T.StructType([
    T.StructField("page", _L),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("track", CATALOG_TRACK)]))),
])

# Artist payload and audio-feature payload (each feature optional).
ARTIST_PAYLOAD = T.StructType([T.StructField("id", _S), T.StructField("genres", T.ArrayType(_S))])
FEATURES_PAYLOAD = T.StructType([T.StructField("id", _S)] + [
    T.StructField(f, _I if f in ("key", "mode", "time_signature") else _D) for f in AUDIO_FEATURES])
