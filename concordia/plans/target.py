"""The target list: change batches applied once each.

``apply_changes`` applies a run's numbered batches (removals before additions) to the
target and records them in a ledger, both in one commit: a batch is in the ledger if
and only if its rows are in the target.  Batches of the run that the ledger holds
are not applied again, so a run that stopped half-way is simply applied again, and
applying a finished run changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.sources.published import Published

LEDGER = "run_id string, op string, batch_no long"


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, op, batch_no) of every batch that was applied."""
    paths = [c.tables["applied"] for c in Published(spark, base).commits() if "applied" in c.written]
    return spark.read.parquet(*paths) if paths else spark.createDataFrame([], LEDGER)


def read_target(spark: SparkSession, base: str) -> DataFrame | None:
    return Published(spark, base).read("target")


def apply_changes(batches: DataFrame, base: str, run_id: str, start: DataFrame | None = None,
                  max_batches: int | None = None, uri: str = "uri") -> int:
    """Apply the (op, uri, batch_no) rows of a run that the ledger does not hold,
    at most ``max_batches`` batches of them; returns how many were applied.
    ``start`` is the target before the first commit (default: empty)."""
    spark = batches.sparkSession
    store = Published(spark, base)
    known = ledger(spark, base).where(F.col("run_id") == run_id).select("op", "batch_no")
    todo = batches.select("op", "batch_no").distinct().join(known, ["op", "batch_no"], "left_anti")
    if max_batches is not None:  # a row per batch, not per item
        todo = todo.orderBy(F.desc("op"), "batch_no").limit(max_batches)
    applied = todo.select(F.lit(run_id).alias("run_id"), "op", F.col("batch_no").cast("long"))
    n = applied.count()
    if not n:
        return 0
    now = store.read("target")
    now = now if now is not None else (start if start is not None else batches).select(uri).where(F.lit(start is not None))
    rows = batches.join(todo, ["op", "batch_no"], "left_semi")
    adds, removes = (rows.where(F.col("op") == op).select(uri).distinct() for op in ("add", "remove"))
    left = now.join(removes, uri, "left_anti")
    target = left.unionByName(adds.join(left, uri, "left_anti"))
    store.publish(f"{run_id}/{len(store.commits())}", {"target": target, "applied": applied})
    return n
