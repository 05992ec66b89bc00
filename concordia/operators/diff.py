"""Snapshot diff: added / removed / unchanged by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.operators.keys import dedupe_last_wins

ADDED, REMOVED, UNCHANGED, CHANGED = "added", "removed", "unchanged", "changed"


def content_hash(cols: list[str]) -> Column:
    """64 bits that tell the contents of rows apart (null and blank differ)."""
    return F.xxhash64(*(part for c in cols for part in (F.col(c).isNull(), F.col(c))))


def diff_snapshots(current: DataFrame, previous: DataFrame | None, key: str = "fingerprint",
                   order: str = "position", cols: list[str] | None = None,
                   compare_cols: list[str] | None = None, hash_col: str = "content_hash") -> DataFrame:
    """Key-only diff of two list states; with ``compare_cols`` rows of one key whose
    contents in these columns differ are ``changed``.

    Contents are compared by their hash, so the join carries one number a side.  A
    previous state that stores it (``hash_col``, over the same columns) need not hold
    the columns themselves.

    Each side is reduced to one row per key (last wins by ``order``), then one
    full outer join on the key labels every key.  Added and unchanged rows come
    from ``current``; removed rows from ``previous``.  With no previous state
    every current row is ``added`` and nothing is deduped.
    """
    cols = cols or [c for c in current.columns if c != key]
    if previous is None:
        return current.select(key, F.lit(ADDED).alias("change_type"), *cols)
    def content(side):
        if not compare_cols:
            return F.lit(0).cast("long")
        return F.col(hash_col) if hash_col in side.columns else content_hash(compare_cols)
    current, previous = (x.withColumn("_content", content(x)) for x in (current, previous))
    cur = dedupe_last_wins(current, key, order).select(key, F.lit(True).alias("_in_c"), F.col("_content").alias("_cc"), *cols)
    types = dict(current.dtypes)
    # a stored state may lack some current columns (e.g. an older snapshot)
    prev = dedupe_last_wins(previous, key, order).select(
        key, F.lit(True).alias("_in_p"), F.col("_content").alias("_pc"),
        *[(F.col(c) if c in previous.columns else F.lit(None).cast(types[c])).alias(f"_p_{c}") for c in cols])
    j = cur.join(prev, key, "full_outer")
    in_c, in_p = F.col("_in_c").isNotNull(), F.col("_in_p").isNotNull()
    change = (F.when(in_c & in_p & (F.col("_cc") != F.col("_pc")), CHANGED).when(in_c & in_p, UNCHANGED)
              .when(in_c, ADDED).otherwise(REMOVED))
    out = [key, change.alias("change_type")]
    out += [F.when(in_c, F.col(c)).otherwise(F.col(f"_p_{c}")).alias(c) for c in cols]
    return j.select(*out)


def diff_counts(diff: DataFrame) -> DataFrame:
    """One row: added, removed, unchanged, has_changes, summary text."""
    ct = F.col("change_type")
    g = diff.agg(
        F.count_if(ct == ADDED).alias("added"),
        F.count_if(ct == REMOVED).alias("removed"),
        F.count_if(ct == UNCHANGED).alias("unchanged"),
    )
    return g.select("added", "removed", "unchanged",
                    ((F.col("added") > 0) | (F.col("removed") > 0)).alias("has_changes"),
                    summary_text("added", "removed", "unchanged").alias("summary"))


def summary_text(a: str, r: str, u: str) -> Column:
    """``+a added, -r removed, u unchanged`` (zero parts omitted, unchanged always)."""
    return F.concat_ws(
        ", ",
        F.when(F.col(a) > 0, F.format_string("+%d added", F.col(a))),
        F.when(F.col(r) > 0, F.format_string("-%d removed", F.col(r))),
        F.format_string("%d unchanged", F.col(u)),
    )
