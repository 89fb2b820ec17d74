"""Embedding whitening: mean and covariance in two passes, principal components scaled to unit variance.

Entries become whole numbers, x = floor(64 c) + 1,000,000, so that the sums of the first pass are exact. The second pass
subtracts the mean and sums outer products, one matrix product a batch; both sums are merged by ``treeAggregate``.
The symmetric eigenproblem is LAPACK's; mean and projection, whose size depends on the dimension alone, are broadcast. Statistics
are over distinct vectors: a vector that many rows share counts once, and copies meet before they are shuffled.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite entry, go; a vector's dimension is that of
most of the remaining rows (ties: the greatest), rows of another dimension go too; entries beyond 2**52 / 64 in size count as
that; a null id stays null, repeated rows are projected each; components whose variance is nil to rounding (fewer distinct vectors
than components, constant dimensions) are left out; a squared deviation beyond a long's range is null; an empty table, or one without
variance, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, materialize, remove

#: Entries in units of 1 / SCALE, moved by OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers up to which doubles are exact, with room for the offset.
LIMIT = 2**52
#: Share of the greatest variance below which a component can't be told from rounding.
LEAST_VARIANCE = 1e-11
#: Rows that a matrix product takes at once.
ROWS = 4_096


@dataclass(frozen=True)
class Whitening:
    """What the passes found: n distinct vectors, exact sums per dimension of x, falling eigenvalues, components as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        """Of x - OFFSET: small numbers keep their digits."""
        return np.array([(s - OFFSET * self.n) / self.n for s in self.sums])


def whole(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows with a finite vector, all of one dimension; in place of the vector ``__x``, its entries as whole numbers less OFFSET."""
    entry = F.col(column).cast("array<double>")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(column).isNotNull() & finite)
    sizes = rows.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    units = F.transform(entry, lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), c * SCALE))))
    return rows.where(F.size(column) == (sizes[0].d if sizes else 0)).where(F.size(column) > 0).withColumn("__x", units)


def matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, np.asarray(part.column(column).flatten(), dtype=np.int64).reshape(part.num_rows, -1)


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``part`` over batches of vectors: one partial a task, merged by ``treeAggregate``."""
    schema = T.StructType.fromDDL("part binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches, 0):
            total = part(x) if total is None else total + part(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.dumps()], pa.binary())], schema=arrow_schema(schema))

    def add(a, b):
        return b if a is None else a if b is None else a + b

    parts = fit.select("__x").mapInArrow(run, schema).rdd
    return parts.treeAggregate(None, lambda total, row: add(total, pickle.loads(row[0])), add)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Per dimension, in Python's whole numbers: 4,096 entries of 52 bits may pass 63 bits."""
    low, high = x & 0xFFFFFFFF, x >> 32
    return low.sum(axis=0).astype(object) + high.sum(axis=0).astype(object) * (1 << 32)


def fit(vectors: DataFrame, column: str = "embedding", components: int = 16) -> Whitening | None:
    """Learns from the distinct vectors; None where there is no variance."""
    distinct = materialize(whole(vectors.select(column), column).select("__x").distinct(), "whitening")
    try:
        n = distinct.count()
        if not n:
            return None
        moved = summed(distinct, exact_sum)
        mean = np.array([s / n for s in moved])
        cov = summed(distinct, lambda x: (x - mean).T @ (x - mean)) / n
        values, columns = np.linalg.eigh((cov + cov.T) / 2)
        values, columns = values[::-1], columns[:, ::-1]
        some = values > max(values[0], 0) * LEAST_VARIANCE
        if not some.any():
            return None
        values, columns = values[some][:components], np.ascontiguousarray(columns[:, some][:, :components])
        project = columns / np.sqrt(values)
        white = summed(distinct, lambda x: ((x - mean) @ project).T @ ((x - mean) @ project)) / n
        error = float(np.abs(white - np.eye(len(values))).max())
        return Whitening(n, [int(s) + OFFSET * n for s in moved], float(np.trace(cov)), values, columns, error)
    finally:
        remove(distinct)


def deviations(x: np.ndarray, n: int, moved: list[int]) -> list[int | None]:
    """Per row the sum over dimensions of (n x - S) squared, exactly; null beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, moved), default=0)
    if most * most * len(moved) < 2**63:
        away = n * x - np.array(moved, np.int64)
        return (away * away).sum(axis=1).tolist()
    sums = (sum((n * int(c) - s) ** 2 for c, s in zip(row, moved, strict=True)) for row in x)
    return [s if s < 2**63 else None for s in sums]


def whiten(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = shared.value
        k, kind, moved = len(m.values), arrow_schema(schema), [s - OFFSET * m.n for s in m.sums]
        project, explained = m.vectors / np.sqrt(m.values), m.values / m.trace
        for part, x in matrices(batches, 1):
            white = (x - m.mean) @ project
            keys = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            cells = [np.tile(np.arange(1, k + 1), len(x)), np.full(len(x) * k, m.n), [d for d in deviations(x, m.n, moved) for _ in range(k)], white.ravel(), np.tile(explained, len(x)), np.full(len(x) * k, m.identity_error)]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, type=f.type) for c, f in zip(cells, list(kind)[1:], strict=True))], schema=kind)

    return whole(vectors.select(F.col(key), F.col(column)), column).select(F.col(key), "__x").mapInArrow(run, schema)
