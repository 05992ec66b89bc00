"""Nested payloads landed as JSON: playlist pages and listen statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions.text import DEFAULT_ITEM_URL_BASE, blank, item_url, join_list, parse_duration, tag_names
from concordia.operators.keys import fingerprint
from concordia.schema import (ARTIST_PAYLOAD, CATALOG_TRACK, FEATURES_PAYLOAD, LISTEN_PAYLOAD, PLAYLIST_PAGE,
                              TARGET_PAGE)


def read_playlist_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLAYLIST_PAGE).json(path)


def flatten_playlist(pages: DataFrame, platform: str = "ytmusic", page_size: int = 100,
                     url_base: str = DEFAULT_ITEM_URL_BASE) -> DataFrame:
    """One row per non-null item: artists joined with ', ' (nameless kept as
    '', null entries dropped), album name, duration in seconds, item url.
    ``position`` = page * page_size + index in page."""
    x = pages.select("page", F.posexplode_outer("tracks").alias("idx", "it")).where(F.col("it").isNotNull())
    names = F.transform(F.filter(F.coalesce(F.col("it.artists"), F.array()), lambda a: a.isNotNull()),
                        lambda a: F.coalesce(a["name"], F.lit("")))
    out = x.select(
        (F.col("page") * page_size + F.col("idx")).cast("long").alias("position"),
        F.lit(platform).alias("platform"),
        blank("it.videoId").alias("track_id"),
        blank("it.title").alias("title"),
        join_list(names).alias("artist"),
        blank("it.album.name").alias("album"),
        blank("it.isrc").alias("isrc"),
        parse_duration(F.col("it.duration_seconds"), F.col("it.duration")).alias("duration"),
        item_url("it.videoId", url_base).alias("url"),
    )
    return out.withColumn("fingerprint", fingerprint())


def build_playlist_pages(tracks: DataFrame, playlist_id: str, page_size: int = 100,
                         null_item: F.Column | None = None) -> DataFrame:
    """Tracks (with position, duration_text, duration_seconds) -> pages of at
    most ``page_size`` items (a bounded group per page)."""
    item = F.struct(
        F.col("title"), F.col("track_id").alias("videoId"), F.col("isrc"),
        F.col("duration_text").alias("duration"), F.col("duration_seconds"),
        F.transform(F.split("artist", ", "), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("id")))
         .alias("artists"),
        F.struct(F.col("album").alias("name")).alias("album"),
    )
    if null_item is not None:
        item = F.when(~null_item, item)
    t = tracks.select(F.floor(F.col("position") / page_size).cast("long").alias("page"),
                      (F.col("position") % page_size).alias("idx"), item.alias("it"))
    return (t.groupBy("page")
             .agg(F.array_sort(F.collect_list(F.struct("idx", "it"))).alias("items"))
             .select(F.lit(playlist_id).alias("playlist_id"), "page",
                     F.transform("items", lambda e: e["it"]).alias("tracks")))


def read_listen_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTEN_PAYLOAD).json(path)


def parse_listen_payloads(payloads: DataFrame) -> DataFrame:
    """Error payloads and empty tracks give no row; an absent count is 0, a
    malformed count drops the row; nameless tags are dropped."""
    ok = payloads.where(F.col("error").isNull() & F.col("track").isNotNull())
    pc, ls = F.trim("track.playcount"), F.trim("track.listeners")
    parsed = ok.select(
        F.col("lookup_artist").alias("artist"), F.col("lookup_title").alias("title"),
        F.when(pc.isNull() | (pc == ""), F.lit(0).cast("long")).otherwise(pc.try_cast("long")).alias("playcount"),
        F.when(ls.isNull() | (ls == ""), F.lit(0).cast("long")).otherwise(ls.try_cast("long")).alias("listeners"),
        tag_names(F.col("track.toptags.tag")).alias("tags"),
    )
    return parsed.where(F.col("playcount").isNotNull() & F.col("listeners").isNotNull())


def read_catalog_tracks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_TRACK).json(path)


def flatten_catalog_track(t: F.Column | str = "t") -> list[F.Column]:
    """Flat match fields of a nested catalogue track: absent keys take their
    defaults, artists are joined with ', ', the first artist's id is kept."""
    x = F.col(t) if isinstance(t, str) else t
    arts = F.filter(F.coalesce(x["artists"], F.array()), lambda a: a.isNotNull())
    return [
        blank(x["id"]).alias("catalog_id"), blank(x["uri"]).alias("uri"),
        blank(x["external_urls"]["spotify"]).alias("url"), blank(x["name"]).alias("name"),
        join_list(F.transform(arts, lambda a: F.coalesce(a["name"], F.lit("")))).alias("artist"),
        blank(x["external_ids"]["isrc"]).alias("isrc"),
        F.coalesce(x["duration_ms"], F.lit(0)).alias("duration_ms"),
        F.coalesce(x["explicit"], F.lit(False)).alias("explicit"),
        F.coalesce(x["popularity"], F.lit(0)).alias("popularity"),
        blank(x["album"]["album_type"]).alias("album_type"),
        F.coalesce(x["track_number"], F.lit(0)).alias("track_number"),
        blank(x["album"]["release_date"]).alias("release_date"),
        F.coalesce(F.element_at(arts, 1)["id"], F.lit("")).alias("artist_id"),
    ]


def catalog_from_payload(tracks: DataFrame) -> DataFrame:
    """Nested catalogue tracks -> the flat catalogue table the resolver reads."""
    return tracks.select(F.struct(*tracks.columns).alias("t")).select(*flatten_catalog_track("t"))


def read_target_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TARGET_PAGE).json(path)


def flatten_target(pages: DataFrame) -> DataFrame:
    """Target list pages -> one row per non-null track (uri + list position)."""
    x = pages.select("page", F.posexplode_outer("items").alias("idx", "it"))
    x = x.where(F.col("it").isNotNull() & F.col("it.track").isNotNull())
    return x.select("page", "idx", *flatten_catalog_track(F.col("it.track")))


def read_artists(spark: SparkSession, path: str) -> DataFrame:
    """Artist payloads -> (artist_id, genres); null payloads and ids dropped."""
    a = spark.read.schema(ARTIST_PAYLOAD).json(path)
    return a.where(F.col("id").isNotNull()).select(
        F.col("id").alias("artist_id"), F.coalesce("genres", F.array().cast("array<string>")).alias("genres"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Audio-feature payloads -> catalog_id + features (absent stay NULL; the
    enrichment step applies the defaults)."""
    f = spark.read.schema(FEATURES_PAYLOAD).json(path)
    return f.where(F.col("id").isNotNull()).withColumnRenamed("id", "catalog_id")
