"""Reports: match rate, method breakdown, status, sync summary, previews.

All are single-pass aggregates (partial + final) over the enriched or plan
tables; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.text import blank
from concordia.operators.match import method_label


def match_rate(enriched: DataFrame, uri: str = "uri") -> DataFrame:
    """total, matched, match_rate (percent; 0 rows -> 0.0)."""
    g = enriched.agg(F.count(F.lit(1)).alias("total"), F.count_if(blank(uri) != "").alias("matched"))
    rate = F.when(F.col("total") > 0, F.lit(100.0) * F.col("matched").cast("double") / F.col("total").cast("double"))\
            .otherwise(F.lit(0.0))
    return g.select("total", "matched", rate.alias("match_rate"))


def method_breakdown(enriched: DataFrame, uri: str = "uri", method: str = "match_method") -> DataFrame:
    """Resolved rows per method (blank -> 'unknown'), count desc then name."""
    return (enriched.where(blank(uri) != "")
                    .groupBy(method_label(method).alias("method"))
                    .agg(F.count(F.lit(1)).alias("n"))
                    .orderBy(F.col("n").desc(), F.col("method")))


def status(source: DataFrame | None, enriched: DataFrame | None, unmatched: DataFrame | None,
           snapshots: DataFrame | None = None, uri: str = "uri", method: str = "match_method") -> DataFrame:
    """(metric, value) rows: the whole status report as one small table."""
    parts = []

    def one(df, metric, expr):
        return df.agg(expr.cast("double").alias("value")).select(F.lit(metric).alias("metric"), "value")

    if source is not None:
        parts.append(one(source, "source_tracks", F.count(F.lit(1))))
    if enriched is not None:
        mr = match_rate(enriched, uri)
        parts.append(mr.select(F.lit("enriched_tracks").alias("metric"), F.col("total").cast("double").alias("value")))
        parts.append(mr.select(F.lit("matched_tracks").alias("metric"), F.col("matched").cast("double").alias("value")))
        parts.append(mr.select(F.lit("match_rate").alias("metric"), F.col("match_rate").alias("value")))
        mb = method_breakdown(enriched, uri, method)
        parts.append(mb.select(F.concat(F.lit("method:"), F.col("method")).alias("metric"),
                               F.col("n").cast("double").alias("value")))
    if unmatched is not None:
        parts.append(one(unmatched, "unmatched_tracks", F.count(F.lit(1))))
    if snapshots is not None:
        parts.append(one(snapshots, "snapshots", F.count_distinct("snapshot_ts")))
        newest = snapshots.groupBy("snapshot_ts").count().orderBy(F.desc("snapshot_ts")).limit(1)
        parts.append(newest.select(F.concat(F.lit("latest_snapshot:"), F.col("snapshot_ts").cast("string")).alias("metric"),
                                   F.col("count").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sync_summary(states: DataFrame, state: str = "state") -> DataFrame:
    """One row: total, already_matched, restored, newly_matched, unmatched, pending."""
    s = F.col(state)
    return states.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "already_matched").alias("already_matched"),
        F.count_if(s == "restored").alias("restored"),
        F.count_if(s == "newly_matched").alias("newly_matched"),
        F.count_if(s.isin("unmatched", "known_unmatched")).alias("unmatched"),
        F.count_if(s == "pending").alias("pending"),
    )


def preview(diff: DataFrame, n: int = 20, order: str = "position") -> DataFrame:
    """First ``n`` rows of each change type (list order) plus the type's total.

    A top-n per group: Spark applies the limit per map task before the
    shuffle, so a huge change type never meets in one task.
    """
    w = Window.partitionBy("change_type").orderBy(F.col(order))
    top = diff.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= n)
    totals = diff.groupBy("change_type").agg(F.count(F.lit(1)).alias("type_total"))
    return top.join(totals, "change_type")
