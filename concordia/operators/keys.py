"""Row identity: fingerprints, last-wins dedupe, list positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.text import blank
from concordia.session import cut_lineage


def fingerprint(platform="platform", track_id="track_id", title="title", artist="artist") -> Column:
    """``platform:track_id`` (case kept) when the id is set, else
    ``lower(platform:title:artist)``."""
    p, i, t, a = (blank(x) for x in (platform, track_id, title, artist))
    return F.when(i != "", F.concat(p, F.lit(":"), i)).otherwise(
        F.lower(F.concat(p, F.lit(":"), t, F.lit(":"), a)))


def with_fingerprint(df: DataFrame, out: str = "fingerprint", **cols) -> DataFrame:
    return df.withColumn(out, fingerprint(**cols))


def dedupe_last_wins(df: DataFrame, key: str | list[str], order: str = "position") -> DataFrame:
    """One row per key: the row with the greatest ``order`` value.

    Written as a top-1-per-key window so Spark plans a partial
    WindowGroupLimit before the shuffle: a key that holds a third of all rows
    is cut to one row per map task before anything moves.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return (df.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") == 1).drop("_rn"))


def with_scan_position(df: DataFrame, out: str = "position") -> DataFrame:
    """Order-preserving position for a freshly scanned file (not dense)."""
    return df.withColumn(out, F.monotonically_increasing_id())


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "row_no",
                      num_partitions: int | None = None) -> DataFrame:
    """Dense 1-based row number over a global order, without a
    single-partition window and without a second shuffle of the rows.

    Range-partition on the order and sort inside each partition; there,
    ``monotonically_increasing_id`` counts rows consecutively (partition id
    in the upper bits, row index in the lower 33).  Each partition's offset
    is the count of all earlier partitions: a table with one row per
    partition (bounded by the partition count), so it is broadcast.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
               .withColumn("_mid", F.monotonically_increasing_id())
               .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
               .withColumn("_lrn", (F.col("_mid") - F.shiftleft(F.col("_pid"), 33)) + 1))
    # written once: the ids feed both the counts and the join, so they must
    # not be recomputed (and a lost executor does not renumber anything)
    local = cut_lineage(local, "row-numbers")
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offs), "_pid")
                 .withColumn(out, F.col("_off") + F.col("_lrn"))
                 .drop("_pid", "_lrn", "_off", "_mid"))
