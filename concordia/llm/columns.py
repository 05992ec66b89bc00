"""Small shared helpers of the operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: the ASCII white space of the contracts: [\x20\x09-\x0D]
WS = " \t\n\x0b\x0c\r"


T = TypeVar("T")


def kept_by_worker(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker makes once and keeps from task to task.  Functions
    reach the workers by value, so their own globals would not last."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landed table; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1 (a null id is never held out, and
    never learned from either: see ``learnable``)."""
    return F.coalesce(_fold(doc_id) == 1, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(_fold(doc_id) != 1, F.lit(False))


def _fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def least_hashed(ids: DataFrame, id_: str, by: str, n: int) -> DataFrame:
    """The ``n`` ids of least hash of every value of ``by``: (id_, by, rank).

    A threshold that follows from each value's count lets few more than ``n`` through,
    so what is ranked in one task is bounded whatever share of the rows a value has;
    a repeated id counts once."""
    h = F.xxhash64(id_)
    share = F.least(F.lit(1.0), (n + 12 * n ** 0.5 + 50) / F.col("_count"))
    counts = ids.groupBy(by).agg(F.approx_count_distinct(id_, 0.02).alias("_count"))  # a row a value
    some = (ids.join(F.broadcast(counts), by).where(h.cast("double") <= share * 1.1 * 2.0 ** 64 - 2.0 ** 63)
            .select(id_, by).distinct())
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(h, id_))).where(F.col("rank") <= n)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterable[str]:
    """The strings of an Arrow column one after another, null as empty."""
    for x in column:
        yield x.as_py() or ""


def emit(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
         for c, f in zip(columns, schema)], schema=schema)
