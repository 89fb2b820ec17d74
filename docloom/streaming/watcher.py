"""A watched folder as a stream: new files of known kinds, each processed exactly once.

A stream's driver remembers each file of its folder, so many files are dealt over folders of bounded size, each a stream of its own. Spark's file sources see empty files and give no row for them; ``take_empty`` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
KINDS = ("md", "txt", "pdf")
#: Files that one watched folder gets, about.
FOLDER = 50_000


def read(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """The stream of files in the folder itself; the checkpoint of the query that writes it remembers what was seen. A folder that isn't there yet is made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.{md,txt,pdf}").option("maxFilesPerTrigger", max_files).load(folder)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("text"))


def ingest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes up what is new and stops; a file that fails leaves its batch to be done again."""
    conf = stream.sparkSession.conf
    # files are small and many: a batch's are listed by a few tasks a core, not one a file, and read as many to a task as their bytes allow
    wanted = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * stream.sparkSession.sparkContext.defaultParallelism),
        "spark.sql.files.openCostInBytes": "32768",
    }
    was = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in was.items():
            conf.set(k, v)


def take_empty(spark: SparkSession, folder: str, target: str) -> None:
    """Adds the empty files of the folder that the table has none of yet, as rows without text; a task lists the folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                files = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
                names = [x.base_name for x in files if x.is_file and not x.size and x.extension in KINDS and x.base_name[0] not in "._"]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"{root}/{n}" for n in names], pa.string()), pa.array([""] * len(names), pa.string())], names=["filename", "file_path", "text"])

    found = spark.createDataFrame([(folder,)], "folder string").coalesce(1).mapInArrow(run, "filename string, file_path string, text string")
    out = spark._jvm.org.apache.hadoop.fs.Path(target)
    if out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(out):
        found = found.join(spark.read.schema(found.schema).parquet(target).select("file_path"), "file_path", "left_anti").select("filename", "file_path", "text")
    found.write.mode("append").parquet(target)
