"""Spark session helpers.

Everything here is plain Spark configuration: AQE (coalescing and skew-join
splitting), ANSI on, UTC session time zone, Arrow for the two Python helpers.
The shared folder used to cut lineage comes from ``spark.checkpoint.dir``; only
a local master falls back to a folder under the warehouse.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "concordia", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` as the
    cluster names it.  Where it is unset (tests, laptops) a folder under
    ``spark.sql.warehouse.dir`` is taken; on a cluster that would be a folder
    of one machine, so there it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        master = spark.sparkContext.master
        shared = "://" in warehouse and not warehouse.startswith("file:")
        if not shared and not re.match(r"local(\[|$)", master):
            raise RuntimeError(
                f"master {master} has no shared scratch folder: set spark.checkpoint.dir "
                "(or put spark.sql.warehouse.dir on shared storage)")
        d = warehouse.rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_RUN_ID = uuid.uuid4().hex[:12]


def run_folder(spark: SparkSession) -> str:
    """This process's own folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/concordia-{_RUN_ID}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under this run's folder.

    Used for written intermediate tables (cutting lineage) and for I/O
    round trips; never a machine-local folder when the cluster names one.
    """
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder this run has written, on whatever store it lies."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_run_folder(spark: SparkSession) -> None:
    """Delete every scratch table of this run (call when its results are out)."""
    drop_path(spark, run_folder(spark))


def cut_lineage(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Materialise ``df`` to the shared folder and read it back.

    Reliable (replicated storage), survives executor loss, and resets the
    plan so iterative stages do not re-run their whole history.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    # known schema: no footer-reading job on the way back
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows dealt evenly over the session's tasks, before work that is heavy
    per row: a small file (or a coalesced shuffle) would be read by one of them."""
    spark = df.sparkSession
    n = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run in the block delete their shuffle files as they end.  Else these
    lie on the disks until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Written intermediate tables of one operator, dropped together.

    ``with Scratch(spark, "name") as s:`` -- ``s.cut(df, "step")`` writes a
    table and reads it back; all of them go when the block ends, so only what
    was cut with ``s.keep`` (the result) stays until the run ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.name = spark, scratch_path(spark, name), name
        self._paths: dict[str, list[str]] = {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        self._paths.setdefault(name, []).append(path)
        return cut_lineage(df, path=path)

    def drop(self, *names: str) -> None:
        """Delete the steps of these names, which nothing will read any more."""
        for name in names:
            for path in self._paths.pop(name, ()):
                drop_path(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df, f"{self.name}-result")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        drop_path(self.spark, self.path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def warm_python_workers(spark: SparkSession) -> None:
    """Start the Python workers once (a fixed per-session cost) by running
    each Arrow helper over a tiny frame with one partition per task slot."""
    from pyspark.sql import functions as F

    from concordia.functions.fmt import fixed
    from concordia.functions.similarity import ratio
    from concordia.functions.text import clean_text_udf
    n = max(int(spark.sparkContext.defaultParallelism), 1)
    df = spark.range(0, n * 4, 1, n).select(
        "id", F.concat(F.lit("a&amp;"), F.col("id").cast("string")).alias("s"))
    df.select(clean_text_udf("s"), ratio(F.col("s"), F.upper("s")), fixed(F.col("id"), 2)) \
      .write.format("noop").mode("overwrite").save()
