"""Incremental runs with Structured Streaming.

New list states (or new source rows) land as files; an ``availableNow`` stream
picks up only files it has not seen (its checkpoint remembers), and
``foreachBatch`` applies each micro-batch to three keyed state tables:

* ``state``: one row per fingerprint, the row that arrived last;
* ``split``: the sync split of every row against the enriched table;
* ``matches``: the match result of every row searched.

A state table is read by merging: a compacted *base* and the *deltas* since.  Each
batch writes its own delta under ``batch_id=<id>`` (overwrite, so a re-delivered
batch rewrites the same folder).  The row of the greatest (batch, position) of a key
counts.  After ``compact_every`` batches the deltas are folded into a new base, one
row per key and dealt by key, which is published with the batch it goes up to; the
folded deltas are deleted.  So a reader meets at most ``compact_every`` deltas, however
many batches there were, and a batch that is re-delivered after it was folded is
older than the base and ignored.

The stream's checkpoint and the state live under the shared checkpoint folder, so
a restarted driver resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.operators.changes import split_existing
from concordia.operators.keys import dedupe_last_wins
from concordia.session import drop_path
from concordia.sources.published import Published, child_names

COMPACT_EVERY = 8       # deltas after which they are folded into the base


class StateTable:
    """One keyed table of the stream's state."""

    def __init__(self, spark: SparkSession, state_dir: str, name: str, key: str, order: str):
        self.spark, self.key, self.order = spark, key, order
        self.deltas, self.base = f"{state_dir}/{name}/deltas", Published(spark, f"{state_dir}/{name}/base")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.deltas}/batch_id={batch_id}")

    def _through(self) -> int:
        last = self.base.latest()
        return last.meta["through"] if last else -1

    def pending(self) -> list[int]:
        """The batches that are not in the base yet."""
        through = self._through()
        ids = (int(n.split("=")[1]) for n in child_names(self.spark, self.deltas) if n.startswith("batch_id="))
        return sorted(i for i in ids if i > through)

    def _merged(self, batches: list[int]) -> DataFrame:
        parts = [p for p in (self.base.read("rows"),) if p is not None]
        if batches:
            paths = [f"{self.deltas}/batch_id={i}" for i in batches]
            new = self.spark.read.option("basePath", self.deltas).parquet(*paths)
            parts.append(new.withColumn("batch_id", F.col("batch_id").cast("long")))
        if not parts:
            raise ValueError(f"{self.deltas}: no batch has been applied")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        w = Window.partitionBy(self.key).orderBy(F.desc("batch_id"), F.desc(self.order))
        return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def read(self) -> DataFrame:
        """One row per key: the one that arrived last."""
        return self._merged(self.pending()).drop("batch_id")

    def compact(self) -> None:
        """Fold all deltas into a new base and delete them."""
        batches = self.pending()
        if not batches:
            return
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self._merged(batches).repartition(n, self.key)
        self.base.publish(f"through-{batches[-1]}", {"rows": rows}, {"through": batches[-1]})
        for name in child_names(self.spark, self.deltas):
            if int(name.split("=")[1]) <= batches[-1]:
                drop_path(self.spark, f"{self.deltas}/{name}")
        self.base.vacuum(keep=2)  # a reader may still be in the base before


def state_tables(spark: SparkSession, state_dir: str, key: str = "fingerprint", order: str = "position") -> dict[str, StateTable]:
    return {"state": StateTable(spark, state_dir, "state", key, order),
            "split": StateTable(spark, state_dir, "split", order, order),
            "matches": StateTable(spark, state_dir, "matches", order, order)}


def land(df: DataFrame, path: str) -> None:
    """An arrival: new files in the landing folder, as many as ``df`` has partitions."""
    df.write.mode("append").parquet(path)


def run_incremental(spark: SparkSession, landing: str, schema: T.StructType, state_dir: str,
                    checkpoint: str, existing: DataFrame | None = None, key: str = "fingerprint",
                    order: str = "position", files_per_batch: int | None = None, catalog=None,
                    cfg=None, compact_every: int = COMPACT_EVERY) -> int:
    """Process every file not yet seen; returns the number of micro-batches run.

    With ``catalog`` (a table or a prebuilt index), each batch's rows that are not
    already resolved in ``existing`` are resolved (three-pass waterfall): only new
    arrivals are searched.
    """
    batches = []
    tables = state_tables(spark, state_dir, key, order)
    if existing is not None:
        ex = existing.select(key, "position", "uri")

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        used = ["state"]
        tables["state"].write(dedupe_last_wins(batch, key, order), batch_id)
        todo = batch
        if existing is not None:
            sp = split_existing(batch, ex, key, order)
            tables["split"].write(sp.select(key, order, "state", "existing_uri"), batch_id)
            todo = sp.where(F.col("state") == "needs_matching").drop("state", "existing_uri")
            used.append("split")
        if catalog is not None:
            from concordia.operators.match import match_waterfall
            tables["matches"].write(match_waterfall(todo, catalog, cfg, id_col=order), batch_id)
            used.append("matches")
        for name in used:
            if len(tables[name].pending()) >= compact_every:
                tables[name].compact()
        batches.append(batch_id)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (reader.parquet(landing).writeStream.foreachBatch(apply_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(batches)


def read_state(spark: SparkSession, state_dir: str, key: str = "fingerprint", order: str = "position") -> DataFrame:
    """Current state: the row of each key that arrived last."""
    return state_tables(spark, state_dir, key, order)["state"].read()


def read_split(spark: SparkSession, state_dir: str, order: str = "position") -> DataFrame:
    """The split of every row seen, as its last batch left it."""
    return state_tables(spark, state_dir, order=order)["split"].read()


def read_matches(spark: SparkSession, state_dir: str, order: str = "position") -> DataFrame:
    """The match result of every row searched, as its last batch left it."""
    return state_tables(spark, state_dir, order=order)["matches"].read()
