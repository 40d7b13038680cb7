"""Whitening of embeddings from covariances found by polarisation.

Entries c become whole numbers x = floor(64 * c) + 1000000. With n fitted
vectors and their sums S, ``n*x - S`` are exactly centred values. No product of
two different dimensions is ever summed: the job sums the squares of every
dimension and of every sum of two dimensions, and

    2 * cov(i, j) = var(i + j) - var(i) - var(j)

gives all covariances. So that whole numbers stay small, squares are taken of
y = x - m, where m is the whole number nearest to the mean, and the rest of the
mean is then taken off exactly: with e = S - n*m, the sum of (n*y - e)^2 over all
rows is n^2 * sum(y^2) - n * e^2. Each task emits one partial sum a pair, Spark
adds them as decimals, and the driver holds the ``dims * (dims + 1) / 2`` totals
(``MOST_DIMS`` bounds them) as Python integers, so the covariance has no rounding
but its last division. ``eigh`` of it gives the components.

Whitened rows are checked: their own covariance is summed over all rows, and its
largest distance from the identity goes into the result.

Defined cases: a vector that is null, empty, or holds null or non-finite entries
takes no part, nor does one whose length is not the commonest (the longer of
equally common ones). Entries beyond 2^62 after scaling stop there. Components
whose eigenvalue is zero to double precision (``FLAT`` of the largest) have no
whitened value and are left out, so equal rows alone give no component. Ids may
be null or repeated: each row stands for itself. ``deviation`` is null where it
does not fit a long. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64.0
SHIFT = 1_000_000
COMPONENTS = 32
MOST_DIMS = 4096
FLAT = 1e-11
SLICE_ROWS = 8192
#: Below this, sums of SLICE_ROWS squares of sums of two fit 64 bits.
SMALL = 1 << 24

SUMS = "i int, j int, total decimal(38,0)"
WHITE = "vec_id long, component int, deviation long, whitened double"


@dataclass(frozen=True)
class Fit:
    """``n`` vectors, their sums per dimension, and the components as columns."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part."""
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.select("vec_id", "embedding").where(v.isNotNull() & (F.size(v) > 0) & ~bad)
    common = kept.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size(v) == (common["d"] if common else 0))


def whole_numbers(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of a batch's vectors as x - SHIFT, with the first row's number."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        vectors = batch.column("embedding").slice(at, SLICE_ROWS)
        c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        yield at, np.clip(np.floor(SCALE * c), -2.0**62, 2.0**62).astype(np.int64)


def exact(x: np.ndarray, limit: int) -> np.ndarray:
    """``x``, as Python integers where it reaches ``limit``."""
    return x if x.size == 0 or max(-int(x.min()), int(x.max())) < limit else x.astype(object)


def emit_sums(totals: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = list(totals)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
         pa.array([str(totals[k]) for k in keys]).cast(pa.decimal128(38, 0))], ["i", "j", "total"])


def added(parts: DataFrame) -> dict[tuple[int, int], int]:
    sums = parts.groupBy("i", "j").agg(F.sum("total").alias("total"))
    return {(r["i"], r["j"]): int(r["total"]) for r in sums.collect()}  # dims * (dims + 1) / 2 rows


def dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors, and the sum of x for each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for _, x in whole_numbers(batch):
                own = exact(x, 1 << 48).sum(axis=0).astype(object)
                n, total = n + len(x), own if total is None else total + own
        if n:
            yield emit_sums({(-1, -1): n} | {(i, i): int(s) + n * SHIFT for i, s in enumerate(total)})

    found = added(rows.select("embedding").mapInArrow(run, SUMS))
    n = found.pop((-1, -1), 0)
    return n, [found[i, i] for i in range(len(found))]


def square_sums(rows: DataFrame, middle: list[int]) -> dict[tuple[int, int], int]:
    """Sums over all rows of y_i^2 under (i, i) and of (y_i + y_j)^2 under (i, j)."""
    centre = np.array([m - SHIFT for m in middle], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, x in whole_numbers(batch):
                y = np.ascontiguousarray(exact(x - centre, SMALL).T)
                for i, own in enumerate(y):
                    pairs = y[i:] + own
                    pairs[0] = own
                    for j, s in enumerate((pairs * pairs).sum(axis=1), i):
                        totals[i, j] = totals.get((i, j), 0) + int(s)
        if totals:
            yield emit_sums(totals)

    return added(rows.select("embedding").mapInArrow(run, SUMS))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the usable ``rows``; None where there is none."""
    n, sums = dimension_sums(rows)
    dims = len(sums)
    if not n:
        return None
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} dimensions: the totals of more than {MOST_DIMS} are not held on the driver")
    middle = [(2 * s + n) // (2 * n) for s in sums]
    squares = square_sums(rows, middle)
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    # n^3 times the variance of a dimension, or of the sum of two
    spread = {(i, j): n * n * total - n * (rest[i] + (rest[j] if i != j else 0)) ** 2 for (i, j), total in squares.items()}
    cov = np.empty((dims, dims))
    for i in range(dims):
        cov[i, i] = spread[i, i] / n**3
    for i, j in itertools.combinations(range(dims), 2):
        cov[i, j] = cov[j, i] = (spread[i, j] - spread[i, i] - spread[j, j]) / (2 * n**3)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    found = values > FLAT * max(float(values[0]), 0.0)
    return Fit(n, sums, values[found], vectors[:, found], sum(spread[i, i] for i in range(dims)) / n**3)


def centred(x: np.ndarray, fitted: Fit) -> np.ndarray:
    """n*x - S, exactly."""
    sums = np.array([s - fitted.n * SHIFT for s in fitted.sums], object)
    small = exact(x, 1 << 40)
    if fitted.n < 1 << 20 and small.dtype != object:
        return fitted.n * x - sums.astype(np.int64)
    return fitted.n * x.astype(object) - sums


def whiten(rows: DataFrame, fitted: Fit) -> DataFrame:
    """``vec_id, component, deviation, whitened`` of usable ``rows``."""
    project, count = fitted.vectors / np.sqrt(fitted.values), len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_numbers(batch):
                d = centred(x, fitted)
                white = d.astype(np.float64) / fitted.n @ project
                roomy = exact(d, math.isqrt(((1 << 63) - 1) // d.shape[1]))
                deviation = [int(s) if s < 1 << 63 else None for s in (roomy * roomy).sum(axis=1)]
                ids = batch.column("vec_id").slice(at, len(x))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(np.arange(len(x)), count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                     pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), count))), pa.array(white.ravel())],
                    ["vec_id", "component", "deviation", "whitened"])

    return rows.mapInArrow(run, WHITE)


def identity_error(rows: DataFrame, fitted: Fit) -> float:
    """The largest entry, by size, of the whitened rows' covariance minus the
    identity. The rows are centred exactly before they are projected."""
    project, count = fitted.vectors / np.sqrt(fitted.values), len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count))
        for batch in batches:
            for _, x in whole_numbers(batch):
                white = centred(x, fitted).astype(np.float64) / fitted.n @ project
                total += white.T @ white
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])

    sums = rows.select("embedding").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    off = F.abs(F.col("total") / fitted.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return sums.agg(F.max(off)).first()[0] or 0.0


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every usable row with every component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``."""
    rows = usable(embeddings)
    fitted = fit(rows, components)
    if fitted is None or not len(fitted.values):
        empty = embeddings.sparkSession.createDataFrame([], WHITE)
        explained, error, n = F.lit(0.0), 0.0, 0
    else:
        empty, n = None, fitted.n
        shares = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values])
        explained, error = F.get(shares, F.col("component") - 1), identity_error(rows, fitted)
    out = whiten(rows, fitted) if empty is None else empty
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
