"""Collections of chunks: tables in segments, with their description, tags and versions.

A collection is a folder of its own; its description goes with its snapshot, so that chunks and description change together or not at
all. Chunks are upserted by id in batches: a batch that breaks a rule is left out whole and reported, the others are written.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .segments import Segments

INFO = "name string, version int, tags array<string>, created_at timestamp, updated_at timestamp, embedding_model string, dimension int"
#: Chunks that go in at once where the caller names no batches.
BATCH = 100


class Collections:
    """Collections under a folder, named after their folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> Segments:
        if not name or name.startswith(("_", ".")) or "/" in name:
            raise ValueError(f"no name for a collection: {name!r}")
        return Segments(self.spark, f"{self.path}/{name}")

    def _known(self, name: str) -> tuple[Segments, dict]:
        held = self._at(name)
        state = held.state()
        if "info" not in state["figures"]:
            raise KeyError(f"no collection {name!r}")
        return held, state

    def _describe(self, held: Segments, was: dict, **new) -> dict:
        info = was["figures"].get("info", {}) | new | {"updated_at": datetime.now(timezone.utc).timestamp()}
        return was["figures"] | {"info": info}

    def names(self) -> list[str]:
        root = Segments(self.spark, self.path)
        return sorted(n for n in root._names() if not n.startswith(("_", ".")) and "info" in self._at(n).state()["figures"])

    def create(self, name: str, tags: list[str] = (), model: str = "", dimension: int = 0) -> None:
        """A new, empty collection; one of that name is emptied."""
        held = self._at(name)
        was = held.state()
        info = {"version": 1, "tags": list(tags), "created_at": datetime.now(timezone.utc).timestamp(), "embedding_model": model, "dimension": dimension}
        held.commit(held.begin(), was, self._describe(held, was, **info), alone=True)

    def get(self, name: str) -> dict:
        """The description; KeyError if there is no such collection."""
        return self._known(name)[1]["figures"]["info"]

    def delete(self, name: str) -> None:
        fs, where = self._at(name)._at()
        fs.delete(where, True)

    def bump_version(self, name: str) -> int:
        held, was = self._known(name)
        version = was["figures"]["info"]["version"] + 1
        held.commit(held.begin(), was, self._describe(held, was, version=version))
        return version

    def version(self, name: str) -> int:
        return self._at(name).state()["figures"].get("info", {}).get("version", 0)

    def list(self) -> DataFrame:
        rows = [(n, i["version"], i["tags"], datetime.fromtimestamp(i["created_at"], timezone.utc), datetime.fromtimestamp(i["updated_at"], timezone.utc), i["embedding_model"], i["dimension"]) for n, i in ((n, self.get(n)) for n in self.names())]
        return self.spark.createDataFrame(rows, INFO).orderBy("name")  # a row a collection

    # chunks ----------------------------------------------------------------------------------

    def add_chunks(self, name: str, chunks: DataFrame) -> DataFrame:
        """Upserts (chunk_id, text, metadata, embedding, ...) by id and reports (batch, rows, error), error null for what was written.

        ``batch`` names a row's batch and ``place`` its place therein; without them rows are one batch. A missing id is ``chunk_{place}``; of
        rows with one id the last by batch and place counts. A batch is left out if any of its rows has neither id nor place, a
        null text, or a vector that isn't of the collection's dimension.
        """
        held, was = self._known(name)
        rows, dimension = chunks, was["figures"]["info"]["dimension"]
        rows = rows if "batch" in rows.columns else rows.withColumn("batch", F.lit(0))
        if "place" in rows.columns:
            rows = rows.withColumn("chunk_id", F.coalesce(F.col("chunk_id"), F.concat(F.lit("chunk_"), F.col("place"))))
        rules: list[tuple[str, Column]] = [("no id", F.col("chunk_id").isNull())]
        if "text" in rows.columns:
            rules.append(("no text", F.col("text").isNull()))
        if dimension and "embedding" in rows.columns:
            rules.append(("dimension", F.coalesce(F.size("embedding"), F.lit(-1)) != dimension))
        broken = F.coalesce(*(F.when(bad, what) for what, bad in rules))
        report = rows.groupBy("batch").agg(F.count("*").alias("rows"), F.min(broken).alias("error"))
        segment = held.begin()
        report = held.put(segment, "report", report)
        good = rows.join(report.where("error is null").select("batch"), "batch", "left_semi")
        others = [c for c in good.columns if c not in ("chunk_id", "batch", "place")]
        order = F.struct(*(c for c in ("batch", "place") if c in good.columns), F.xxhash64(*others))
        last = good.groupBy("chunk_id").agg(F.max_by(F.struct(*others), order).alias("row")).select("chunk_id", "row.*") if others else good.select("chunk_id").distinct()
        written = held.put(segment, "chunks", last)
        held.put(segment, "gone", written.select("chunk_id"))
        held.commit(segment, was, self._describe(held, was))
        return report

    def remove_chunks(self, name: str, ids: DataFrame) -> None:
        held, was = self._known(name)
        segment = held.begin()
        held.put(segment, "gone", ids.select("chunk_id").distinct())
        held.commit(segment, was, self._describe(held, was))

    def compact(self, name: str) -> None:
        """The living chunks as one segment; older ones can be vacuumed."""
        held, was = self._known(name)
        rows = held.live("chunks", was)
        if rows is not None and len(was["segments"]) > 1:
            segment = held.begin()
            held.put(segment, "chunks", rows)
            held.commit(segment, was, alone=True)

    def chunks(self, name: str) -> DataFrame:
        """The chunks of the newest snapshot, each id once."""
        held, was = self._known(name)
        rows = held.live("chunks", was)
        return rows if rows is not None else self.spark.createDataFrame([], "chunk_id string, text string")

    def count(self, name: str) -> int:
        return self.chunks(name).count()


def numbered(chunks: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """With ``batch`` and ``place``: ``size`` rows a batch by ``order``; places count within ranges of it, so that no task sees all rows."""
    from pyspark.sql import Window

    rows = chunks.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return rows.withColumn("place", nth).withColumn("batch", F.struct(F.col("__part").alias("part"), F.floor(F.col("place") / size).alias("nth"))).drop("__part")


def all_tags(info: DataFrame) -> DataFrame:
    """One row: the distinct tags of all collections, sorted."""
    return info.select(F.explode("tags").alias("tag")).distinct().agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def with_tags(info: DataFrame, tags: list[str]) -> DataFrame:
    return info.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
