"""Match-result table (the resume cache).

Append-only Parquet partitioned by ``run_id``; readers keep one entry per
fingerprint (a positive entry beats a negative one).  A dry run writes
nothing; a finished run can drop its partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.schema import MATCH_RESULT
from concordia.sources.published import has_files


def write_match_results(results: DataFrame, base: str, run_id: str) -> None:
    cols = [f.name for f in MATCH_RESULT.fields]
    df = results.select(*[(F.col(c) if c in results.columns else F.lit(None)).cast(f.dataType).alias(c)
                          for c, f in zip(cols, MATCH_RESULT.fields)])
    # a repeated run replaces its own partition
    (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(base))


def read_match_cache(spark: SparkSession, base: str | None, run_ids: list[str] | None = None) -> DataFrame:
    """One row per fingerprint; absent table -> empty.  ``run_ids`` limits
    the read to the given runs (partition pruning), e.g. the run being
    resumed; finished runs are simply not read again."""
    if not has_files(spark, base):
        return spark.createDataFrame([], MATCH_RESULT)
    df = spark.read.parquet(base)
    if run_ids is not None:
        df = df.where(F.col("run_id").isin(*run_ids))
    rest = [f.name for f in MATCH_RESULT.fields if f.name not in ("fingerprint", "matched")]
    best = df.groupBy("fingerprint").agg(
        F.max_by(F.struct(*rest), F.struct(F.col("matched"), F.col("run_id"), F.col("uri"))).alias("e"),
        F.max("matched").alias("matched"))
    return best.select("fingerprint", "matched", "e.*")
