"""What the operators of this subpackage share: shared storage, Arrow plumbing and text cells."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import release

#: Characters of text that one vectorised step holds at once in a Python worker.
SLICE_CHARS = 1_000_000
#: Spark's setting by which an execution's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees (``spark.checkpoint.dir``). Where none is set, a session of one machine gets a local one; a cluster's fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all of it sees")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/docloom-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, any executor may be lost.
    The shuffle files go with the write, since nothing reads them again."""
    spark = df.sparkSession
    path, before = shared_path(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes a table that ``materialize`` wrote."""
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        files = df_or_path.inputFiles()
        if not files:
            return
        df_or_path = files[0].rsplit("/", 1)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(df_or_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be none of the columns'."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, columns: list[str], schema: str, step: Callable[..., list[tuple] | Iterator[tuple]], context: Callable | None = None, encodes: bool = False) -> DataFrame:
    """Runs ``step(*columns of a slice)`` on slices of bounded text volume and returns its rows.

    The last of ``columns`` decides the volume (its strings or bytes are counted). ``context()`` is
    called once a task and its value goes to ``step`` first. Unless the step ``encodes``, the worker lets go
    of the encoder that an earlier stage has left it.
    """
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = arrow_schema(out)
        if not encodes:
            release()
        first = (context(),) if context else ()
        for batch in batches:
            for lo, hi in spans(volumes(batch.column(batch.num_columns - 1))):
                # only a slice's cells are Python objects at any time
                rows = list(step(*first, *(column.to_pylist() for column in batch.slice(lo, hi - lo).columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return df.select(*columns).mapInArrow(run, out)


def slices(texts: list, chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    return spans([len(text or "") for text in texts], chars)


def volumes(column: pa.Array) -> list[int]:
    """Bytes of a string or binary column's cells, elements of others; 0 for null."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_pylist()
    return [len(cell or "") for cell in column.to_pylist()]


def spans(lengths: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of stretches that end where their lengths, and 64 a cell, add up to ``most``."""
    lo = total = 0
    for i, length in enumerate(lengths):
        total += length + 64
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(lengths):
        yield lo, len(lengths)


def label_bucket(doc_id):
    """crc32 of the id as text, modulo 5: 0 marks a held-out row."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
