"""The query log as a stream's sink: entries are appended once, statistics are kept up to date and overwritten.

A micro-batch is written under its stream's name and number. A batch that comes again (after a crash between the write and the
checkpoint, or because the stream starts anew) is known by them and changes nothing. Statistics are sums, so a batch's are added to those of the snapshot
before; both tables are in segments, readers see a batch whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.segments import Segments

#: Characters of an entry's text that the log keeps.
PREVIEW = 200
STATS = "event_type string, total long, errors long, seconds double, longest double, sketch binary"


class LogSink:
    """Entries (id, ts, event_type, seconds, text) go to ``log``, sums by event type to ``stats``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log, self.sums = spark, Segments(spark, f"{path}/log", "id"), Segments(spark, f"{path}/stats", "event_type")

    def put(self, name: str, batch: DataFrame, number: int) -> None:
        """``foreachBatch``'s function but for the stream's name."""
        entries = batch.withColumn("text", F.substring("text", 1, PREVIEW))
        self._once(self.log, name, number, lambda segment, was: self.log.put(segment, "entries", entries), False)
        self._once(self.sums, name, number, lambda segment, was: self.sums.put(segment, "stats", self._added(entries, was)), True)

    def _once(self, table: Segments, name: str, number: int, write, alone: bool) -> None:
        was = table.state()
        if number <= was["figures"].get(name, -1):
            return
        segment = table.begin()
        write(segment, was)
        table.commit(segment, was, was["figures"] | {name: number}, alone)

    def _added(self, entries: DataFrame, was: dict) -> DataFrame:
        now = entries.groupBy("event_type").agg(
            F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.max("seconds").alias("longest"), F.kll_sketch_agg_double("seconds").alias("sketch")
        )
        before = self.sums.live("stats", was)
        both = now if before is None else now.unionByName(before)
        return both.groupBy("event_type").agg(F.sum("total").alias("total"), F.sum("errors").alias("errors"), F.sum("seconds").alias("seconds"), F.max("longest").alias("longest"), F.kll_merge_agg_double("sketch").alias("sketch")).coalesce(1)  # a row an event type

    def write(self, name: str, stream: DataFrame, checkpoint: str) -> None:
        """Takes up what is new and stops."""
        stream.writeStream.foreachBatch(lambda batch, number: self.put(name, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def entries(self) -> DataFrame:
        rows = self.log.live("entries")
        return rows if rows is not None else self.spark.createDataFrame([], "id long, ts timestamp, event_type string, seconds double, text string")

    def stats(self) -> DataFrame:
        """(event_type, total, errors, seconds, longest, p95): the p95 is a sketch's, see ``evaluation.RANK_ERROR``."""
        rows = self.sums.live("stats")
        rows = rows if rows is not None else self.spark.createDataFrame([], STATS)
        return rows.select("event_type", "total", "errors", "seconds", "longest", F.kll_sketch_get_quantile_double("sketch", F.lit(0.95)).alias("p95"))
