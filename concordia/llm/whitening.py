"""Embedding whitening by shifted Cholesky QR.

Method: with A the centred rows, every *pass* is one Spark aggregate, the Gram
matrix of A R^-1 for the triangular factors R found so far (a triangular solve
per batch of rows).  Its Cholesky factor, of the Gram matrix plus a small shift
as long as that is ill-conditioned, is composed into R.  Passes end when the rows
are orthonormal; then A = Q R, and the singular values and right vectors of the
d x d matrix R are those of A: eigenvalue e = s^2 / n, component = right vector.
Unlike one eigendecomposition of the covariance this keeps components whose
variance is many orders below the largest one's.

Directions whose singular value is below ``RANK`` of the largest are rounding
noise: they are projected out and the passes go on in the rest.

Only d x d sums (a row per cell and task, summed by Spark) reach the driver, and
only the d-vector of sums and the d x 32 projection go to the tasks.

Centring is exact: with n rows and integer sums S, n*x - S is an integer, which
is divided by n once.

Defined cases
* null vectors, empty ones, ones with a null, NaN or infinite entry, and ones
  with an entry whose x is beyond ``LARGEST`` are left out;
* of vectors of different lengths, those of the commonest length count (the
  longer one on a tie), the others are left out;
* repeated rows and null ids are rows like any other;
* components without variance (constant, or a mixture of others) are not
  returned; a table without variance or without rows gives an empty result;
* a ``deviation`` that is no 64-bit integer is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import emit, table
from concordia.session import Scratch

SCALE, OFFSET = 64, 1_000_000   # x = floor(64 * c) + 1000000
COMPONENTS = 32
LARGEST = 1 << 61
RANK = 1e-11            # least singular value, relative to the largest
ORTHONORMAL = 1e-12     # of the Gram matrix, per entry
PASSES = 12
ROWS = 1 << 13          # rows that are solved at a time

_LOW = (1 << 32) - 1


def quantised(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): the rows of a list column that remain, as integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    values = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False)
    c = values.astype(np.float64).reshape(len(at), width)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * c)
        good = (np.abs(x) < LARGEST).all(axis=1)  # false for NaN as well
    return at[good], x[good].astype(np.int64) + OFFSET


def solve_triangular(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a R^-1 for an upper triangular R, column by column."""
    q = np.empty_like(a)
    for j in range(r.shape[0]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


@dataclass(frozen=True)
class Moments:
    """Number of rows and exact sums of every dimension."""
    n: int
    sums: tuple[int, ...]

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: 64-bit integers where they fit, else Python's."""
        largest = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        if largest < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.spread(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n*x - S)^2 of every row."""
        y = self.spread(x)
        if y.dtype != object and (not y.size or int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63):
            return np.einsum("ij,ij->i", y, y).tolist()
        exact = (y.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learned: x is whitened as centred(x) @ projection."""
    moments: Moments
    components: np.ndarray      # a column each, unit length
    eigenvalues: np.ndarray
    trace: float
    passes: int

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def vector_width(vectors: DataFrame) -> int:
    """The commonest length of a vector without holes; 0 if there is none.  The
    lengths of a table are few, and are counted in Spark."""
    found = (vectors.select(F.size("embedding").alias("width")).where("width > 0").groupBy("width").count()
             .orderBy(F.desc("count"), F.desc("width")).first())
    return found.width if found else 0


_SUMS = pa.schema([("cell", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64())])
_CELLS = pa.schema([("cell", pa.int32()), ("value", pa.float64())])


def moments(vectors: DataFrame, width: int) -> Moments:
    """Exact counts and sums; x goes in two halves, so no sum can overflow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.arange(width, dtype=np.int32)
        for b in batches:
            _, x = quantised(b.column(0), width)
            if len(x):
                yield emit(_SUMS, cells, (x >> 32).sum(axis=0), (x & _LOW).sum(axis=0), np.full(width, len(x)))

    big = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    rows = (vectors.select("embedding").mapInArrow(run, "cell int, high long, low long, n long")
            .groupBy("cell").agg(*big, F.sum("n").alias("n")).orderBy("cell").collect())  # a row per dimension
    return Moments(rows[0].n, tuple((int(r.high) << 32) + int(r.low) for r in rows)) if rows else Moments(0, ())


def gram(vectors: DataFrame, width: int, rows_of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of q^T q over all rows, q = rows_of(x): a partial matrix per task,
    cell by cell, added up by Spark."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            _, x = quantised(b.column(0), width)
            for k in range(0, len(x), ROWS):
                q = rows_of(x[k:k + ROWS])
                total += q.T @ q
        yield emit(_CELLS, np.arange(len(upper[0]), dtype=np.int32), total[upper])

    cells = (vectors.select("embedding").mapInArrow(run, "cell int, value double")
             .groupBy("cell").agg(F.sum("value").alias("value")).toArrow())  # d(d+1)/2 numbers
    out = np.zeros((size, size))
    place = cells["cell"].to_numpy()
    out[upper[0][place], upper[1][place]] = cells["value"].to_numpy()
    return out + np.triu(out, 1).T


def _factor(g: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular R with R^T R = g + shift, the shift only where g alone
    could not be factored or solved with."""
    d = len(g)
    values = np.linalg.eigvalsh(g)
    shift = 0.0
    if values[0] < 1e-6 * values[-1]:
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * values[-1]
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * values[-1])


def fit(vectors: DataFrame, width: int, count: int = COMPONENTS) -> Whitening | None:
    """The leading components of all vectors, None if they do not vary."""
    m = moments(vectors, width) if width else Moments(0, ())
    if m.n < 2:
        return None
    basis, factors = np.eye(width), []  # rows are centred(x) @ basis, then solved with the factors
    scale = 0.0

    def rows_of(x, basis, factors):
        q = m.centred(x)
        q = q @ basis if basis.shape[1] < width else q
        for r in factors:
            q = solve_triangular(q, r)
        return q

    for k in range(1, PASSES + 1):
        b, f = basis, tuple(factors)
        g = gram(vectors, width, lambda x: rows_of(x, b, f), b.shape[1])
        if not factors:
            if not np.trace(g) > 0:
                return None
            scale = scale or math.sqrt(np.linalg.eigvalsh(g)[-1])
            constant = np.diag(g) == 0
            if constant.any() and basis.shape[1] == width:  # these never vary; the others go on
                basis = basis[:, ~constant]
                g = g[np.ix_(~constant, ~constant)]
        elif np.abs(g - np.eye(len(g))).max() <= ORTHONORMAL * math.sqrt(m.n):
            break
        factors.append(_factor(g, m.n))
        r = np.linalg.multi_dot(factors[::-1]) if len(factors) > 1 else factors[0]
        _, s, v = np.linalg.svd(r)
        noise = s < RANK * scale
        if noise.any():
            basis, factors = basis @ v[~noise].T, []
    r = np.linalg.multi_dot(factors[::-1]) if len(factors) > 1 else factors[0]
    _, s, v = np.linalg.svd(r)
    e = s ** 2 / m.n
    components = basis @ v[:count].T
    return Whitening(m, components / np.linalg.norm(components, axis=0), e[:count], float(e.sum()), k)


def whitened(vectors: DataFrame, model: Whitening, width: int) -> DataFrame:
    """(vec_id, deviation, whitened array) of every remaining row."""
    m, projection = model.moments, model.projection
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = quantised(b.column(1), width)
            w = m.centred(x) @ projection
            ends = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
            yield emit(schema, b.column(0).take(pa.array(at)), m.deviation(x),
                       pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel())))

    return (vectors.select(F.col("vec_id").cast("long"), "embedding")
            .mapInArrow(run, "vec_id long, deviation long, whitened array<double>"))


def identity_error(vectors: DataFrame, model: Whitening, width: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity; their
    mean is taken off as well."""
    m, projection = model.moments, model.projection
    size = projection.shape[1] + 1  # a column of ones gives the sums
    g = gram(vectors, width, lambda x: np.c_[m.centred(x) @ projection, np.ones(len(x))], size) / m.n
    mean = g[:-1, -1]
    return float(np.abs(g[:-1, :-1] - np.outer(mean, mean) - np.eye(size - 1)).max())


_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every remaining row on every component, whitened."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    width = vector_width(vectors)
    model = fit(vectors, width)
    if model is None:
        return spark.createDataFrame([], _RESULT)
    error = identity_error(vectors, model, width)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
    with Scratch(spark, "whitening") as scratch:
        return scratch.keep(
            whitened(vectors, model, width).select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
            .select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.moments.n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(explained, F.col("pos")).alias("explained"),
                    F.lit(error).alias("identity_error")))
