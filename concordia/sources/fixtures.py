"""Landed tables derived from the driver tables.

The reconciliation engine works on any source list x catalogue.  For the
shipped test data the catalogue, the source playlist, previous/current
states, the enriched table, the match cache, the target playlist and the
lookup tables (artists, audio features, listen statistics) are all derived
from ``part`` / ``events`` / ``embeddings`` with the rules below, so every
query's work grows with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators.keys import fingerprint
from concordia.sources.tables import read_table


#: what is added to the position of a row that comes again later in the list
LATER = 1 << 40


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _part(spark, sf_dir, cols):
    return read_table(spark, sf_dir, "part", cols)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir, ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("c"), _s(k)).alias("catalog_id"),
        F.concat(F.lit("cat:track:c"), _s(k)).alias("uri"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("artist"),
        F.concat(F.lit("IS"), F.lpad(_s(k), 8, "0")).alias("isrc"),
        (F.col("p_size") * 6000).cast("int").alias("duration_ms"),
        (k % 5 == 0).alias("explicit"),
        (k % 101).cast("int").alias("popularity"),
        F.col("p_type").alias("album_type"),
        (k % 20).cast("int").alias("track_number"),
        F.concat(F.lit("20"), F.lpad(_s(k % 25), 2, "0")).alias("release_date"),
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part(spark, sf_dir, ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    m6 = k % 6
    title = (F.when(m6 == 0, name)
             .when(m6 == 1, F.concat(name, F.lit(" (feat. Guest)")))
             .when(m6 == 2, F.concat(name, F.lit(" ft. Guest")))
             .when(m6 == 3, F.concat(F.upper(name), F.lit(" [Official Video]")))
             .when(m6 == 4, F.concat(name, F.lit(" live")))
             .otherwise(F.concat(F.replace(name, F.lit(" "), F.lit(" &amp; ")), F.lit("  (Radio  Edit)"))))
    artist = (F.when(k % 7 == 0, F.lit("Guest"))
              .when(k % 4 == 0, F.concat(brand, F.lit(", Guest")))
              .otherwise(brand))
    duration = F.when(k % 17 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(1), F.col("p_size") * 6 + (k % 13 - 6)).cast("double"))
    return p.select(
        k.alias("position"),
        F.lit("ytmusic").alias("platform"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("y"), _s(k))).alias("track_id"),
        title.alias("title"),
        artist.alias("artist"),
        F.col("p_type").alias("album"),
        F.when(k % 3 == 0, F.concat(F.lit("IS"), F.lpad(_s(k), 8, "0"))).otherwise(F.lit("")).alias("isrc"),
        duration.alias("duration"),
    )


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).withColumn("fingerprint", fingerprint())


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).where(F.col("position") % 10 != 3)


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    kd = keyed(spark, sf_dir)
    base = kd.where(F.col("position") % 10 != 7)
    dup = kd.where(F.col("position") % 50 == 1).select(
        (F.col("position") + LATER).alias("position"), "platform", "track_id",
        F.concat(F.col("title"), F.lit(" v2")).alias("title"),
        "artist", "album", "isrc", "duration", "fingerprint")
    return base.unionByName(dup)


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched table's rows of the last run, one for every item: resolved on
    every 4th position and on half of those that the current list has lost."""
    p = F.col("position")
    resolved = (p % 4 == 0) | (p % 20 == 7)
    return keyed(spark, sf_dir).select(
        "position", "fingerprint", "title", "artist",
        F.when(resolved, F.concat(F.lit("cat:track:c"), _s(p))).otherwise(F.lit("")).alias("uri"),
        F.when(~resolved, F.lit("")).when(p % 8 == 0, F.lit("isrc")).when(p % 12 == 0, F.lit(""))
         .otherwise(F.lit("title_artist")).alias("match_method"),
        F.when(p % 12 == 0, F.lit(0)).otherwise((p % 101).cast("int")).alias("popularity"),
    )


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match cache, an entry for every item: a quarter is of this list (hits
    and misses), the others are of items that went by another key."""
    p = F.col("position")
    hit = p % 8 == 1

    def of_hits(value, name):
        return F.when(hit, value).alias(name)
    return keyed(spark, sf_dir).select(
        F.when((p % 8).isin(1, 5), F.col("fingerprint")).otherwise(F.concat(F.lit("retired:"), F.col("fingerprint"))).alias("fingerprint"),
        hit.alias("matched"),
        F.when(hit, F.concat(F.lit("cat:track:c"), _s(p))).otherwise(F.lit("")).alias("uri"),
        of_hits(F.concat(F.lit("https://open.example/track/c"), _s(p)), "url"),
        of_hits(F.when(p % 3 != 0, F.lit("title_artist")), "method"),
        of_hits(F.when(p % 3 != 0, 0.5 + (p % 50) / F.lit(100.0)), "confidence"),
        of_hits(F.when(p % 5 != 0, F.concat(F.lit("IC"), F.lpad(_s(p), 8, "0"))), "isrc"),
        of_hits(p % 7 == 0, "explicit"),
        of_hits(F.concat(F.lit("19"), F.lpad(_s(p % 90), 2, "0")), "album_release_date"),
        of_hits((p % 300 * 1000).cast("int"), "duration_ms"), of_hits((p % 97).cast("int"), "popularity"),
        of_hits(F.when(p % 2 == 1, F.lit("single")), "album_type"), of_hits((p % 12).cast("int"), "track_number"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target list, a uri for every catalogue row: a third are its own, the
    others are of tracks that the catalogue does not have."""
    own = F.col("popularity") % 3 == 0
    return catalog(spark, sf_dir).select(F.when(own, F.col("uri")).otherwise(F.replace("uri", F.lit(":c"), F.lit(":x"))).alias("uri"))


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist lookup table: one row per artist id, genres sorted.

    Genres per artist are a small natural set (distinct album types here);
    ``collect_set`` is partial-aggregated, so a popular artist never brings
    its rows into one task, only its distinct genres.
    """
    p = _part(spark, sf_dir, ["p_brand", "p_type"])
    return (p.groupBy(F.col("p_brand").alias("artist_id"))
             .agg(F.array_sort(F.collect_set("p_type")).alias("genres")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio features per catalogue id (present for the ids with an embedding)."""
    e = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])

    def f(i):
        return F.element_at("embedding", i).cast("double")

    return e.select(
        F.concat(F.lit("c"), _s("vec_id")).alias("catalog_id"),
        f(1).alias("danceability"), f(2).alias("energy"), f(3).alias("valence"),
        f(4).alias("tempo"),
        F.floor((f(5) + F.lit(1.0)) * F.lit(6.0)).cast("int").alias("key"),
        F.when(f(6) >= 0, F.lit(1)).otherwise(F.lit(0)).alias("mode"),
        f(7).alias("loudness"), f(8).alias("speechiness"), f(9).alias("acousticness"),
        f(10).alias("instrumentalness"), f(11).alias("liveness"),
        (F.lit(3) + F.when(f(12) >= 0, F.lit(1)).otherwise(F.lit(0))).alias("time_signature"),
    )


def listen_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type"])
    return ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("playcount"),
        F.count_distinct("event_type").alias("listeners"))


def listen_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listen statistics keyed by (artist, title): user u listens to part u."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "event_type"])
    per_user = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("playcount"),
        F.count_distinct("event_type").alias("listeners"),
        F.collect_set("event_type").alias("tags"))
    p = _part(spark, sf_dir, ["p_partkey", "p_name", "p_brand"])
    j = per_user.join(p, per_user.user_id == p.p_partkey)
    # One row per (user, tag); counts are taken from each user's first tag row
    # so the whole thing is one partial-aggregated pass (sets stay bounded by
    # the tag vocabulary, whatever the group size).
    x = j.select("p_brand", "p_name", "playcount", "listeners",
                 F.posexplode_outer("tags").alias("_pos", "_tag"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    return (x.groupBy(F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
             .agg(F.sum(F.when(first, F.col("playcount"))).alias("playcount"),
                  F.sum(F.when(first, F.col("listeners"))).alias("listeners"),
                  F.array_sort(F.collect_set("_tag")).alias("tags")))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched (typed, 39-column) table as a previous run left it."""
    from concordia.operators.enrich import with_track_defaults
    ex = existing(spark, sf_dir)
    kd = keyed(spark, sf_dir).select("position", "platform", "track_id", "album", "isrc", "duration")
    return with_track_defaults(ex.join(kd, "position"))


def sync_inputs(spark: SparkSession, sf_dir: str):
    from concordia.plans.sync import SyncInputs
    return SyncInputs(current=current(spark, sf_dir), catalog=catalog(spark, sf_dir),
                      previous=previous(spark, sf_dir), existing=existing(spark, sf_dir),
                      cache=cache(spark, sf_dir), target=target(spark, sf_dir),
                      artists=artists(spark, sf_dir), features=features(spark, sf_dir),
                      listen=listen_stats(spark, sf_dir), artist_id_col="artist")
