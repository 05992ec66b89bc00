"""Resolving in slices that are committed one by one.

A run's rows are dealt by key into slices; each is resolved and its results are
published before the next one starts.  A run that stops (lost driver, time limit) is
started again under the same id and goes on with the first slice that is not
committed.  Results do not depend on the slicing: every row is resolved by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.config import MatchConfig
from concordia.operators.match import CatalogIndex, build_catalog_index, match_waterfall
from concordia.session import cut_lineage, spread
from concordia.sources.published import Published

SLICES = 8


def _key(run_id: str, k: int, slices: int) -> str:
    return f"{run_id}/{k}-of-{slices}"


def resolve_in_slices(rows: DataFrame, catalog: DataFrame | CatalogIndex, base: str, run_id: str,
                      slices: int = SLICES, cfg: MatchConfig | None = None, key: str = "fingerprint",
                      id_col: str = "position", stop_after: int | None = None) -> bool:
    """Resolve the slices that are not committed yet; ``stop_after`` ends the call
    after so many.  True if the run is complete.  ``rows`` must be the same in every
    call of a run."""
    spark = rows.sparkSession
    store = Published(spark, base)
    done = {c.key for c in store.commits()}
    todo = [k for k in range(slices) if _key(run_id, k, slices) not in done]
    if not todo:
        return True
    rows = cut_lineage(spread(rows).withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices))), "to-resolve")
    index = catalog if isinstance(catalog, CatalogIndex) else build_catalog_index(catalog, cfg)
    for k in todo if stop_after is None else todo[:stop_after]:
        part = rows.where(F.col("_slice") == k)
        found = match_waterfall(part, index, cfg, id_col=id_col).join(part.select(id_col, key), id_col)
        store.publish(_key(run_id, k, slices), {"results": found})
    return stop_after is None or len(todo) <= stop_after


def resolved(spark: SparkSession, base: str, run_id: str) -> DataFrame | None:
    """The results of all committed slices of a run; None if there is none."""
    paths = [c.tables["results"] for c in Published(spark, base).commits() if c.key.startswith(f"{run_id}/")]
    return spark.read.parquet(*paths) if paths else None
