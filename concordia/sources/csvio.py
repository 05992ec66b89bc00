"""CSV edge: enriched / unmatched exports and source imports.

Reading: header-named, all-string columns (no inference, no NA guessing),
quoted newlines and doubled quotes allowed, empty cells -> ''.  Missing
columns get defaults, unknown columns are ignored, then text is typed with
the sentinel rules (empty -> sentinel).  ``mode='strict'`` fails on a bad
number (ANSI cast), ``mode='permissive'`` turns it into the sentinel.

Writing: fixed column order, header, empty cells for blanks.  Spark writes
a directory of part files and no byte-order mark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import fmt
from concordia.functions.text import blank, first_nonblank, parse_bool
from concordia.sources.csvsplit import read_csv_records
from concordia.sources.published import has_files, largest_file
from concordia.schema import ENRICHED_COLUMNS, INTERNAL_TO_EXPORT, TRACK_COLUMNS, TRACK_DEFAULTS, UNMATCHED_COLUMNS

_FOUR = ["danceability", "energy", "valence", "speechiness", "acousticness", "instrumentalness", "liveness"]


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """All-string frame named by the file header (BOM-tolerant).  Files that fit
    a split are read whole, a task each; larger ones by many (``csvsplit``)."""
    if largest_file(spark, path) > _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")):
        return read_csv_records(spark, path).drop("position")
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
               .option("inferSchema", False).option("encoding", "UTF-8").csv(path))
    # a UTF-8 BOM can survive on the first header name
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def _bytes(size: str) -> int:
    """A Spark size (128MB, 16m, 134217728b) in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def _typed(c: str, raw, mode: str):
    t = dict(TRACK_COLUMNS)[c]
    s = blank(raw)
    if t.typeName() == "string":
        return s
    if t.typeName() == "boolean":
        return parse_bool(s)
    d = F.lit(TRACK_DEFAULTS[c]).cast(t)
    conv = s.try_cast(t) if mode == "permissive" else s.cast(t)
    if mode == "permissive":
        conv = F.coalesce(conv, d)
    return F.when(s == "", d).otherwise(conv)


def typed_tracks(raw: DataFrame, mode: str = "strict", keep: tuple[str, ...] = ()) -> DataFrame:
    """Export-named string columns -> internal typed track table (+ ``keep``)."""
    have = set(raw.columns)

    def col(export_name):
        return F.col(export_name) if export_name in have else F.lit(None).cast("string")

    out = []
    for c, _ in TRACK_COLUMNS:
        e = INTERNAL_TO_EXPORT.get(c, c)
        if c == "isrc":
            out.append(first_nonblank(col("isrc"), col("isrc_enriched")).alias("isrc"))
        else:
            out.append(_typed(c, col(e), mode).alias(c))
    return raw.select(*keep, *out)


def read_enriched(spark: SparkSession, path: str | None, mode: str = "strict") -> DataFrame:
    """Enriched export -> typed tracks; absent path -> empty typed table."""
    if not has_files(spark, path):
        from concordia.schema import TRACK_TYPES
        from pyspark.sql import types as T
        return spark.createDataFrame([], T.StructType([T.StructField(c, t) for c, t in TRACK_TYPES.items()]))
    return typed_tracks(read_csv_strings(spark, path), mode)


def export_columns(tracks: DataFrame) -> DataFrame:
    """Typed tracks -> the 40 export text columns, in order."""
    fetched = F.coalesce(F.col("audio_features_fetched"), F.lit(False))
    resolved = blank("uri") != ""
    m = {}
    for c in ["title", "artist", "album", "isrc", "platform", "track_id", "added_date", "added_by", "url",
              "uri", "catalog_url", "release_date", "artist_genres", "album_type", "tags", "match_method",
              "first_synced", "last_synced"]:
        m[INTERNAL_TO_EXPORT.get(c, c)] = blank(c)
    m["duration"] = F.when(F.coalesce("duration", F.lit(0.0)) != 0, fmt.float_text("duration")).otherwise(F.lit(""))
    m["spotify_duration_ms"] = fmt.nonzero_text("duration_ms")
    m["isrc_enriched"] = blank("isrc")
    m["explicit"] = F.when(resolved, F.when(F.coalesce("explicit", F.lit(False)), "true").otherwise("false"))\
                     .otherwise(F.lit(""))
    for c in _FOUR:
        m[c] = F.when(fetched, fmt.fixed(c, 4)).otherwise(F.lit(""))
    m["tempo"] = F.when(fetched, fmt.fixed("tempo", 1)).otherwise(F.lit(""))
    m["loudness"] = F.when(fetched, fmt.fixed("loudness", 2)).otherwise(F.lit(""))
    for c in ("key", "mode"):
        m[c] = F.when(fetched & (F.col(c) >= 0), F.col(c).cast("string")).otherwise(F.lit(""))
    m["time_signature"] = F.when(fetched, F.col("time_signature").cast("string")).otherwise(F.lit(""))
    m["audio_features_fetched"] = fmt.flag_text("audio_features_fetched")
    for c in ("popularity", "track_number", "playcount", "listeners"):
        m[INTERNAL_TO_EXPORT.get(c, c)] = fmt.nonzero_text(c)
    m["match_confidence"] = F.when(F.coalesce("match_confidence", F.lit(0.0)) != 0,
                                   fmt.fixed("match_confidence", 2)).otherwise(F.lit(""))
    return tracks.select(*[m[c].alias(c) for c in ENRICHED_COLUMNS])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", False)
       .option("emptyValue", "").csv(path))


def write_enriched(tracks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(export_columns(tracks), path, mode)


def write_unmatched(tracks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    cols = {"trackId": "track_id"}
    write_csv(tracks.select(*[blank(cols.get(c, c)).alias(c) for c in UNMATCHED_COLUMNS]), path, mode)


def read_source_tracks(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Source list export (title, artist required) -> typed tracks + position.

    ``position`` is the row's place in its file, files in the order of their paths
    (list order for last-wins and limits), however the files are split."""
    raw = read_csv_records(spark, path)
    missing = {"title", "artist"} - set(raw.columns)
    if missing:
        raise ValueError(f"source file lacks required columns: {sorted(missing)}")
    return typed_tracks(raw, mode, keep=("position",))


__all__ = ["read_csv_strings", "typed_tracks", "read_enriched", "export_columns", "write_csv", "write_enriched",
           "write_unmatched", "read_source_tracks"]
