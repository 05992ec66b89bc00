"""Range joins on bucketed numbers.

A band join ``|a - b| <= tolerance`` as an equi-join: the left row goes to its own
bucket and the two beside it, the right row to its own.  Buckets are a little wider
than the tolerance, so rounding cannot put a pair two buckets apart; the exact test
follows on the few pairs of a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_width(tolerance: float) -> float:
    return max(float(tolerance), 1e-3) * 1.0001


def band(value: Column, tolerance: float) -> Column:
    return F.floor(value / F.lit(band_width(tolerance)))


def bands_around(value: Column, tolerance: float) -> Column:
    own = band(value, tolerance)
    return F.array(own - 1, own, own + 1)


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_value: str, right_value: str,
              tolerance: float) -> DataFrame:
    """Inner join on the columns ``on`` and ``|left_value - right_value| <=
    tolerance``.  Rows without a value match nothing; the two sides must not share
    other column names."""
    a = left.where(F.col(left_value).isNotNull()).withColumn("_band", F.explode(bands_around(F.col(left_value).cast("double"), tolerance)))
    b = right.where(F.col(right_value).isNotNull()).withColumn("_band", band(F.col(right_value).cast("double"), tolerance))
    return (a.join(b, [*on, "_band"])
            .where(F.abs(F.col(left_value) - F.col(right_value)) <= F.lit(float(tolerance))).drop("_band"))
