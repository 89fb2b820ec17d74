"""A cell index of vectors: trained centres, a table partitioned by cell, searches that read the probed cells only.

Centres are the k-means of a bounded sample (``sample`` vectors of lowest hash): each pass assigns in Arrow batches with the centres
broadcast (nlist rows) and adds up per cell before it shuffles. Every vector is indexed, in segments, so vectors can be added, replaced
and removed. A search sends each query to the ``nprobe`` cells of greatest inner product; queries and vectors meet by cell in matrix
products. Cells of many vectors are dealt into slices and queries into blocks, so that no group of the meeting holds more than ``SLICE`` vectors or
``BLOCK`` queries; only k hits a query and group are shuffled on. With nprobe = nlist the result is that of exact search.

Defined cases: vectors without id or embedding are skipped; of rows with one id within one call any one counts; cells that training
leaves without vectors keep their centre; an empty index finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.segments import Segments
from .vectors import first_of_each, order_by

#: Vectors and queries that meet in one group at most, in the mean of a hash.
SLICE, BLOCK = 100_000, 20_000


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def nearest_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)


def arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, embedding) with their ``cell``."""
    shared, schema = vectors.sparkSession.sparkContext.broadcast(centres), T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = nearest_cells(matrix(batch.column("embedding")), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], schema=arrow(schema))

    return vectors.mapInArrow(run, schema)


def one_pass(sample: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The means of the cells that the centres make."""
    shared, schema = sample.sparkSession.sparkContext.broadcast(centres), T.StructType.fromDDL("cell int, n long, sums array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centres), np.int64), np.zeros_like(centres)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                cell = nearest_cells(x, shared.value)
                n += np.bincount(cell, minlength=len(n))
                np.add.at(sums, cell, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], schema=arrow(schema))

    width, out = centres.shape[1], centres.copy()
    parts = sample.select("embedding").mapInArrow(run, schema).groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    for r in parts.collect():  # a row a cell
        out[r.cell] = np.array(r[2:]) / r.n
    return out


def train(vectors: DataFrame, nlist: int, sample: int, passes: int = 8) -> np.ndarray:
    """nlist centres, or as many as there are vectors: they start from the sample's vectors of lowest hash."""
    held = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).persist()
    try:
        first = held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(nlist).select("embedding").collect()  # nlist rows
        centres = np.array([r.embedding for r in first], dtype=float)
        for _ in range(passes if len(first) else 0):
            centres = one_pass(held, centres)
        return centres
    finally:
        held.unpersist()


class CellIndex:
    """A collection's vectors under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.segments = spark, Segments(spark, path, "vec_id")

    def build(self, vectors: DataFrame, nlist: int = 128, sample: int | None = None, passes: int = 8) -> None:
        """Trains on at most ``sample`` vectors (256 a cell unless told) and indexes all; what was there goes."""
        rows = self._good(vectors)
        centres = train(rows, nlist, sample or 256 * nlist, passes)
        self._write(rows, centres, self.segments.state(), {"centres": centres.tolist(), "sizes": {}}, alone=True)

    def add(self, vectors: DataFrame) -> None:
        """Indexes further vectors, which replace those of equal id; centres stay."""
        was = self.segments.state()
        if not was["segments"]:
            raise ValueError("the index has no centres yet: build it first")
        self._write(self._good(vectors), np.array(was["figures"]["centres"]), was, was["figures"])

    def remove(self, ids: DataFrame) -> None:
        was, segment = self.segments.state(), self.segments.begin()
        self.segments.put(segment, "gone", ids.select("vec_id").where("vec_id is not null").distinct())
        self.segments.commit(segment, was)

    def _good(self, vectors: DataFrame) -> DataFrame:
        rows = vectors.where("vec_id is not null and embedding is not null").withColumn("embedding", F.col("embedding").cast("array<double>"))
        return rows.select("vec_id", "embedding").groupBy("vec_id").agg(F.max("embedding").alias("embedding"))

    def _write(self, rows: DataFrame, centres: np.ndarray, was: dict, figures: dict, alone: bool = False) -> None:
        segment = self.segments.begin()
        if len(centres):
            placed = assigned(rows, centres)
            put = self.segments.put(segment, "vectors", placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4))), ("cell",))
            if not alone:
                self.segments.put(segment, "gone", put.select("vec_id"))
            more = {str(r.cell): r.n for r in put.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
            # replaced vectors count twice until the index is built anew: sizes only decide how cells are dealt
            figures = figures | {"sizes": {c: figures["sizes"].get(c, 0) + more.get(c, 0) for c in figures["sizes"] | more}}
        self.segments.commit(segment, was, figures, alone)

    def scan(self, cells: list[int] | None = None) -> DataFrame | None:
        """(vec_id, embedding, cell) of the living vectors, of the given cells only."""
        return self.segments.live("vectors", where=lambda df: df if cells is None else df.where(F.col("cell").isin(cells)))

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(query_id, query, cell): the cells that each query looks into."""
        centres = np.array(self.segments.state()["figures"]["centres"])
        kind = queries.schema["query_id"].dataType
        shared, schema = self.spark.sparkContext.broadcast(centres), T.StructType([T.StructField("query_id", kind), T.StructField("query", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])
        n = min(nprobe, len(centres))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    met = matrix(batch.column(1)) @ shared.value.T
                    cell = np.argsort(-met, axis=1, kind="stable")[:, :n]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.ravel(), pa.int32())], schema=arrow(schema))

        asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("query"))
        return asked.mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int, nprobe: int = 16, itself: bool = True) -> DataFrame:
        """(query_id, vec_id, score, rank) from the probed cells; without ``itself`` a query doesn't find the vector of its own id."""
        figures = self.segments.state()["figures"]
        schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", self._id_type()), T.StructField("score", T.DoubleType())])
        if not figures.get("sizes"):
            return self.spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
        probes = self.probes(queries, nprobe)
        cells = sorted(r.cell for r in probes.select("cell").distinct().collect())  # at most nlist
        slices = {int(c): -(-n // SLICE) for c, n in figures["sizes"].items()}
        blocks = 1 + queries.count() // BLOCK
        split = F.create_map(*(F.lit(x) for c, n in slices.items() for x in (c, n)))
        asked = probes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce(split[F.col("cell")], F.lit(1)) - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        held = self.scan(cells).withColumn("slice", F.pmod(F.xxhash64("vec_id"), split[F.col("cell")].cast("long")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def meet(rows: pa.Table, those: pa.Table) -> pa.Table:
            kind = arrow(schema)
            if not rows.num_rows or not those.num_rows:
                return kind.empty_table()
            ids, names = np.array(rows["vec_id"].to_pylist(), dtype=object), np.array(those["query_id"].to_pylist(), dtype=object)
            x, q = matrix(rows["embedding"]), matrix(those["query"])
            out = [np.empty(0, int), np.empty(0), np.empty(0, object)]
            for lo in range(0, len(q), step := max(1, 4_000_000 // len(x))):
                met = np.round(q[lo : lo + step] @ x.T, 9)
                if not itself:
                    met[names[lo : lo + step, None] == ids[None, :]] = -np.inf
                least = np.partition(met, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(met), -np.inf)
                a, b = np.nonzero((met >= least[:, None]) & (met > -np.inf))
                best = first_of_each(a, met[a, b], ids[b], k) if len(a) else np.empty(0, int)
                out = [np.r_[out[0], a[best] + lo], np.r_[out[1], met[a[best], b[best]]], np.r_[out[2], ids[b[best]]]]
            return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip((names[out[0]].tolist(), out[2].tolist(), out[1]), kind, strict=True)], schema=kind)

        by = ("cell", "slice", "block")
        hits = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(meet, schema)
        return hits.withColumn("rank", F.row_number().over(order_by("query_id", "vec_id"))).where(F.col("rank") <= k)

    def _id_type(self) -> T.DataType:
        rows = self.segments.live("vectors")
        return rows.schema["vec_id"].dataType if rows is not None else T.LongType()
