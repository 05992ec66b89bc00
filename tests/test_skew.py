"""A third of all rows on one key: results stay whole and exact."""

from pyspark.sql import functions as F

from concordia.operators import enrich as N
from concordia.operators.diff import diff_counts, diff_snapshots
from concordia.sources import fixtures as fx

SF001 = "/root/testdata/sf0.001"


def test_diff_with_hot_fingerprint(spark):
    cur = fx.current(spark, SF001)
    hot = F.col("position") % 3 == 0
    cur_hot = cur.withColumn("fingerprint", F.when(hot, F.lit("yt:hot")).otherwise(F.col("fingerprint")))
    prev = fx.previous(spark, SF001)
    d = diff_snapshots(cur_hot, prev, cols=["position", "title"]).cache()
    hot_rows = d.where(F.col("fingerprint") == "yt:hot").collect()
    assert len(hot_rows) == 1 and hot_rows[0].position == cur_hot.where(hot).agg(F.max("position")).first()[0]
    c = diff_counts(d).first()
    n_keys = cur_hot.select("fingerprint").distinct().count()
    assert c.added + c.unchanged == n_keys


def test_lookup_fans_out_to_every_row_of_a_hot_id(spark):
    tracks = N.with_track_defaults(spark.range(3000).select(
        F.col("id").alias("position"),
        F.when(F.col("id") % 3 == 0, F.lit("cat:track:c1")).otherwise(
            F.concat(F.lit("cat:track:c"), (F.col("id") % 200).cast("string"))).alias("uri")))
    out = N.backfill_metadata(tracks, fx.catalog(spark, SF001))
    assert out.count() == 3000
    assert out.where(F.col("uri") == "cat:track:c1").where(F.col("duration_ms") > 0).count() == \
        tracks.where(F.col("uri") == "cat:track:c1").count()


def test_dedupe_keeps_one_row_for_hot_key_across_partitions(spark):
    from concordia.operators.keys import dedupe_last_wins
    df = spark.range(0, 30000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("fingerprint"),
        F.col("id").alias("position"))
    out = dedupe_last_wins(df, "fingerprint")
    assert out.count() == 20001
    assert out.where(F.col("fingerprint") == "hot").first().position == 29997
