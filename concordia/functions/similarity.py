"""String similarity.

``ratio`` is the Ratcliff/Obershelp ratio (stdlib ``difflib``, no junk heuristic); it is
asymmetric, so it is always called as (source, candidate).  Blank on either
side scores 0.  It runs as one Arrow-batched helper and is meant to be
applied to *distinct* string pairs (see ``pair_similarity``), never per
candidate row.  ``levenshtein`` is the JVM-native alternative metric.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.DoubleType())
def _unequal_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = SequenceMatcher(autojunk=False)  # one rule for strings of any length
    out = np.zeros(len(a))
    for i in np.flatnonzero(pc.and_(a.is_valid(), b.is_valid())):
        pairs.set_seqs(a[i].as_py(), b[i].as_py())
        out[i] = pairs.ratio()
    return pa.array(out)


def ratio(a: Column, b: Column) -> Column:
    """Ratio of two normalised strings; blank and equal ones need no Python."""
    blank = F.coalesce((F.length(a) == 0) | (F.length(b) == 0), F.lit(True))
    nothing = F.lit(None).cast("string")
    equal = a == b
    return F.when(blank, 0.0).when(equal, 1.0).otherwise(
        _unequal_ratio(F.when(~blank & ~equal, a).otherwise(nothing), F.when(~blank & ~equal, b).otherwise(nothing)))


def levenshtein_sim(a: Column, b: Column) -> Column:
    """1 - edit_distance / max(len); blank on either side -> 0."""
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(F.lower(a), F.lower(b)).cast("double") / F.greatest(la, lb).cast("double"))


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """Lossless upper bound of the ratio: 2*min(la, lb) / (la + lb)."""
    la, lb = F.length(a).cast("double"), F.length(b).cast("double")
    return F.when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(F.lit(2.0) * F.least(la, lb) / (la + lb))


def similarity(a: Column, b: Column, metric: str = "ratio") -> Column:
    if metric == "levenshtein":
        return levenshtein_sim(a, b)
    if metric == "ratio":
        return ratio(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def pair_similarity(pairs: DataFrame, a: str, b: str, out: str, metric: str = "ratio") -> DataFrame:
    """Similarity of each *distinct* (a, b) pair.

    The Python helper sees every distinct pair once, however many candidate
    rows share it; the result is joined back on (a, b) by the caller.
    """
    d = pairs.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    return d.select(F.col("_a").alias(a), F.col("_b").alias(b),
                    similarity(F.col("_a"), F.col("_b"), metric).alias(out))
