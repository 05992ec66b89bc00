"""Sync planning operators: state splits, limits, change sets, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.config import TARGET_BATCH
from concordia.operators.keys import dedupe_last_wins, global_row_number
from concordia.schema import MATCH_RESULT

ALREADY, NEEDS = "already_matched", "needs_matching"
RESTORED, KNOWN_UNMATCHED, SEARCH, PENDING = "restored", "known_unmatched", "search", "pending"


def split_existing(current: DataFrame, existing: DataFrame, key: str = "fingerprint",
                   order: str = "position", uri: str = "uri") -> DataFrame:
    """Label every current row: ``already_matched`` when the enriched table
    (last row per key) holds a resolved uri for its key, else ``needs_matching``.

    Adds ``state`` and ``existing_uri``; current rows are kept as they are (also
    their ``last_synced``, which is newer than the enriched table's if it is set).
    """
    ex = (dedupe_last_wins(existing.where(F.col(key).isNotNull()), key, order)
          .select(key, F.col(uri).alias("existing_uri")))
    j = current.join(ex, key, "left")
    has = F.coalesce(F.col("existing_uri"), F.lit("")) != ""
    return j.select(*current.columns, F.when(has, ALREADY).otherwise(NEEDS).alias("state"),
                    F.when(has, F.col("existing_uri")).otherwise(F.lit("")).alias("existing_uri"))


#: What a positive cache entry restores, and what stands in where it is absent.
RESTORED_FIELDS = {"url": "", "method": "cached", "confidence": 0.0, "isrc": "", "explicit": False,
                   "album_release_date": "", "duration_ms": 0, "popularity": 0, "album_type": "", "track_number": 0}
_ENTRY_TYPES = {f.name: f.dataType for f in MATCH_RESULT.fields}


def cache_entry(cache: DataFrame) -> Column:
    """A cache row as a typed struct of all its fields, absent ones by default."""
    def one(c, default):
        have = F.col(c).cast(_ENTRY_TYPES[c]) if c in cache.columns else F.lit(None).cast(_ENTRY_TYPES[c])
        return F.coalesce(have, F.lit(default).cast(_ENTRY_TYPES[c])).alias(c)
    return F.struct(F.coalesce(F.col("uri"), F.lit("")).alias("uri"), *(one(c, d) for c, d in RESTORED_FIELDS.items()))


def dedupe_cache(cache: DataFrame, key: str = "fingerprint") -> DataFrame:
    """One cache entry per key, whole; a positive entry beats a negative one."""
    return (cache.groupBy(key)
                 .agg(F.max(F.struct(F.col("matched"), cache_entry(cache).alias("entry"))).alias("e"))
                 .select(key, F.col("e.matched").alias("cache_matched"), F.col("e.entry").alias("cache_entry")))


def no_entry() -> Column:
    """The entry of rows that are not restored."""
    fields = ["uri", *RESTORED_FIELDS]
    return F.lit(None).cast("struct<" + ",".join(f"{c}:{_ENTRY_TYPES[c].simpleString()}" for c in fields) + ">")


def cache_split(needs: DataFrame, cache: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Three-way split of rows still to resolve: ``restored`` (positive cache
    entry, which comes along as ``cache_entry``), ``known_unmatched`` (negative
    entry) or ``search`` (no entry)."""
    j = needs.join(dedupe_cache(cache, key), key, "left")
    state = (F.when(F.col("cache_matched").isNull(), SEARCH)
             .when(F.col("cache_matched"), RESTORED).otherwise(KNOWN_UNMATCHED))
    restored = F.col("state") == RESTORED
    return j.withColumn("state", state).withColumns(
        {"cache_uri": F.when(restored, F.col("cache_entry.uri")).otherwise(F.lit("")),
         "cache_entry": F.when(restored, F.col("cache_entry"))})


def limit_pending(to_search: DataFrame, n: int | None, order: str = "position") -> DataFrame:
    """First ``n`` rows (list order) stay ``search``; the rest become ``pending``.

    The cut is a scalar subquery (the n-th position), so rows are labelled in
    place; only ``n`` positions ever meet in one task, never the rows.
    """
    if n is None:
        return to_search.withColumn("state", F.lit(SEARCH))
    if n <= 0:
        return to_search.withColumn("state", F.lit(PENDING))
    cut = to_search.select(order).orderBy(order).limit(n).agg(F.max(order)).scalar()
    return to_search.withColumn("state", F.when(F.col(order) <= cut, SEARCH).otherwise(PENDING))


def to_add(wanted_uris: DataFrame, target: DataFrame, uri: str = "uri") -> DataFrame:
    """Idempotent add set: resolved uris not yet in the target, once each."""
    w = wanted_uris.select(uri).where(F.coalesce(F.col(uri), F.lit("")) != "").distinct()
    return w.join(target.select(uri), uri, "left_anti")


def to_remove(removed: DataFrame, existing: DataFrame, wanted_uris: DataFrame | None = None,
              key: str = "fingerprint", order: str = "position", uri: str = "uri",
              strict_parity: bool = False) -> DataFrame:
    """Uris of removed items (via the enriched table), once each.

    By default a uri that another current item still resolves to is kept
    (``strict_parity=True`` removes it anyway, as the original tool did).
    """
    ex = dedupe_last_wins(existing, key, order).select(key, uri)
    r = (removed.select(key).join(ex, key).where(F.coalesce(F.col(uri), F.lit("")) != "")
                .select(uri).distinct())
    if not strict_parity and wanted_uris is not None:
        r = r.join(wanted_uris.select(uri).distinct(), uri, "left_anti")
    return r


def change_batches(adds: DataFrame, removes: DataFrame, batch: int = TARGET_BATCH,
                   uri: str = "uri") -> DataFrame:
    """(op, uri, batch_no): adds and removes numbered in uri order, ``batch``
    uris per write call, without a single-partition window."""
    out = []
    for op, df in (("add", adds), ("remove", removes)):
        n = global_row_number(df.select(uri), [uri], "_row")
        out.append(n.select(F.lit(op).alias("op"), uri,
                            F.floor((F.col("_row") - 1) / F.lit(batch)).cast("long").alias("batch_no")))
    return out[0].unionByName(out[1])


def retry_upsert(existing: DataFrame, newly: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Replace the rows of newly resolved keys, keep every other row."""
    keep = existing.join(newly.select(key).distinct(), key, "left_anti")
    return keep.unionByName(newly.select(*existing.columns))
