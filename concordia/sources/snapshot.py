"""List-state snapshots.

Parquet partitioned by ``snapshot_ts`` (append one partition per run); "latest" is a
query (max partition), not a second copy.  Every row carries a hash of its content,
so a later diff can tell changed rows from one column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.operators.diff import content_hash
from concordia.operators.keys import fingerprint
from concordia.sources.published import has_files

CONTENT_COLS = ["title", "artist", "album", "duration"]
SNAPSHOT_COLS = ["position", "platform", "track_id", "title", "artist", "album", "duration"]


def save_snapshot(tracks: DataFrame, base: str, snapshot_ts: str) -> None:
    """Write ``tracks`` as the partition ``snapshot_ts`` (platform kept); a
    repeated run replaces its own partition and no other."""
    (tracks.select(*SNAPSHOT_COLS, content_hash(CONTENT_COLS).alias("content_hash")).withColumn("snapshot_ts", F.lit(snapshot_ts))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("snapshot_ts").parquet(base))


def snapshot_history(spark: SparkSession, base: str) -> DataFrame:
    """(snapshots, latest): number of snapshots and the newest timestamp."""
    df = spark.read.parquet(base)
    return df.agg(F.count_distinct("snapshot_ts").alias("snapshots"), F.max("snapshot_ts").alias("latest"))


def load_latest_snapshot(spark: SparkSession, base: str | None) -> DataFrame | None:
    """Rows of the newest partition, with fingerprints; None where there is no
    snapshot yet (a first run)."""
    if not has_files(spark, base):
        return None
    df = spark.read.parquet(base)
    latest = df.select(F.max("snapshot_ts")).scalar()
    return df.where(F.col("snapshot_ts") == latest).withColumn("fingerprint", fingerprint())
