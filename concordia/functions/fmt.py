"""Export-edge text formats for the enriched file.

Numbers in the file are fixed-decimal text: 4 places for audio features, 1
for tempo, 2 for loudness and confidence; zero counts are written blank;
flags are ``true`` or blank; explicit is only written for resolved rows.
Python formats the exact binary value (``0.125`` -> ``0.12``) while Java's
formatter rounds the shortest decimal half-up (``0.13``), so the fixed
formats use one Arrow-batched helper.  This runs only when a file is
written; typed doubles stay in Parquet.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fmt_array(values: pa.Array, spec: str) -> pa.Array:
    return pa.array([None if v is None else format(v, spec) for v in values.to_pylist()], type=pa.string())


@F.arrow_udf(T.StringType())
def _fmt4(v: pa.Array) -> pa.Array:
    return _fmt_array(v, ".4f")


@F.arrow_udf(T.StringType())
def _fmt2(v: pa.Array) -> pa.Array:
    return _fmt_array(v, ".2f")


@F.arrow_udf(T.StringType())
def _fmt1(v: pa.Array) -> pa.Array:
    return _fmt_array(v, ".1f")


@F.arrow_udf(T.StringType())
def _repr(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None else repr(float(x)) for x in v.to_pylist()], type=pa.string())


_FIXED = {4: _fmt4, 2: _fmt2, 1: _fmt1}


def fixed(c: Column | str, digits: int) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return _FIXED[digits](x.cast("double"))


def float_text(c: Column | str) -> Column:
    """Shortest round-trip text of a double (``215.0``)."""
    x = F.col(c) if isinstance(c, str) else c
    return _repr(x.cast("double"))


def nonzero_text(c: Column | str) -> Column:
    """Integer text, blank when zero/NULL."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(x, F.lit(0)) != 0, x.cast("string")).otherwise(F.lit(""))


def flag_text(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(x, F.lit(False)), F.lit("true")).otherwise(F.lit(""))
