"""Document files as a data source, batch and stream: ``spark.read.format("document_files").load(folder)``.

A row a file: its name, path, kind, domain (the first folder below the root), pages, text, and an error in place of these where the file can't be
read: an unknown kind, bytes that aren't UTF-8, a PDF without a reader or one that the reader fails on. One bad file never stops
the others. The driver lists the folder (two levels, hidden names left out); tasks read a group of files each, ``groupBytes`` of them together. Paths are
those of ``pyarrow.fs`` (local, hdfs://, s3://, gs://), which all executors have to reach; ``files.load_folder`` reads any path that Spark does.

The stream's offset is the newest modification time so far with the paths of that time: a file is taken up once, those that come later with an older
time are not seen. A PDF reader is a function of the module named in ``pdfReader`` ("module:function"), from bytes to the pages' texts.

Options: ``path``; ``groupBytes`` (16 MB); ``unknown`` ("report", the default, or "skip"); ``pdfReader``.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import markdown_text

NAME = "document_files"
SCHEMA = "filename string, file_path string, file_type string, domain string, total_pages int, pages array<struct<page:int,text:string>>, full_text string, error string"
KINDS = ("pdf", "md", "txt")


@dataclass
class Group(InputPartition):
    """Files that one task reads: (path, relative path)."""

    files: list[tuple[str, str]]


def listed(path: str, unknown: str) -> list[tuple[int, str, str, int]]:
    """(modified, path, relative path, size) of the files two levels deep, sorted; FileNotFoundError without such a folder or file."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    root = root.rstrip("/")
    top = system.get_file_info(root)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if top.type == fs.FileType.File:
        return [(top.mtime_ns or 0, path, top.base_name, top.size)]
    prefix = path.rstrip("/")[: -len(root)] if path.rstrip("/").endswith(root) else ""
    found, folders = [], [root]
    for depth in range(2):
        here, folders = folders, []
        for folder in here:
            for x in system.get_file_info(fs.FileSelector(folder)):
                if x.base_name.startswith("."):
                    continue
                if x.type == fs.FileType.Directory:
                    folders.append(x.path)
                elif unknown != "skip" or x.extension.lower() in KINDS:
                    found.append((x.mtime_ns or 0, prefix + x.path, x.path[len(root) + 1 :], x.size))
    return sorted(found)


def grouped(files: list[tuple[int, str, str, int]], most: int) -> list[Group]:
    groups, size = [], most
    for _, path, relative, n in files:
        if size + n > most or len(groups[-1].files) >= 1_000:
            groups.append(Group([]))
            size = 0
        groups[-1].files.append((path, relative))
        size += n
    return groups


def pages_of(data: bytes, kind: str, pdf_reader: str | None) -> list[tuple[int, str]]:
    if kind == "pdf":
        if not pdf_reader:
            raise ValueError("no PDF reader")
        module, _, name = pdf_reader.partition(":")
        texts = getattr(importlib.import_module(module), name)(data)
        return [(i, t.strip()) for i, t in enumerate(texts, 1) if t.strip()]
    if kind not in KINDS:
        raise ValueError(f"unknown kind of file: {kind or 'none'}")
    return [(1, data.decode("utf-8"))]


def rows_of(group: Group, options: dict) -> Iterator[tuple]:
    from pyarrow import fs

    for path, relative in group.files:
        name = relative.rsplit("/", 1)[-1]
        kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
        domain = relative.split("/", 1)[0] if "/" in relative else "general"
        try:
            system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with system.open_input_stream(at) as stream:
                pages = pages_of(stream.read(), kind, options.get("pdfreader"))
            yield name, path, kind, domain, len(pages), pages, "\n\n".join(t for _, t in pages), None
        except Exception as x:  # the row carries it
            yield name, path, kind, domain, 0, [], None, f"{type(x).__name__}: {x}"


class Files(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Group]:
        return grouped(listed(self.options["path"], self.options.get("unknown", "report")), int(self.options.get("groupbytes", 16 << 20)))

    def read(self, partition: Group) -> Iterator[tuple]:
        return rows_of(partition, self.options)


class FileStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def initialOffset(self) -> dict:
        return {"time": -1, "paths": []}

    def _files(self) -> list[tuple[int, str, str, int]]:
        try:
            return listed(self.options["path"], self.options.get("unknown", "report"))
        except FileNotFoundError:  # a folder may come later
            return []

    def latestOffset(self) -> dict:
        files = self._files()
        last = max((t for t, *_ in files), default=-1)
        return {"time": last, "paths": sorted(p for t, p, *_ in files if t == last)}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        new = [f for f in self._files() if (f[0] > start["time"] or f[0] == start["time"] and f[1] not in start["paths"]) and (f[0] < end["time"] or f[0] == end["time"] and f[1] in end["paths"])]
        return grouped(new, int(self.options.get("groupbytes", 16 << 20)))

    def read(self, partition: Group) -> Iterator[tuple]:
        return rows_of(partition, self.options)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Files:
        return Files(self.options)

    def streamReader(self, schema) -> FileStream:
        return FileStream(self.options)


def plain(df: DataFrame) -> DataFrame:
    """Markdown without images and fences, as text."""
    text: Column = F.when(F.col("file_type") == "md", markdown_text(F.col("full_text"))).otherwise(F.col("full_text"))
    return df.withColumn("full_text", text)


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(DocumentFiles)
    return plain(spark.read.format(NAME).options(**options).load(path))


def load_document(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One document as one row; FileNotFoundError if there is no such file, ValueError if its kind is unknown."""
    (_, _, name, _), = listed(path, "report")
    if name.rsplit(".", 1)[-1].lower() not in KINDS:
        raise ValueError(f"unknown kind of file: {name}")
    return load(spark, path, **options)


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(DocumentFiles)
    return plain(spark.readStream.format(NAME).options(**options).load(path))


def write_files(docs: DataFrame, folder: str) -> int:
    """Writes (relative, content) rows as files below the folder, each task its own; a task that runs again overwrites. Gives their number."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        n, made = 0, set()
        for batch in batches:
            for relative, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (parent := f"{root}/{relative}".rsplit("/", 1)[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(f"{root}/{relative}") as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return docs.select("relative", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
