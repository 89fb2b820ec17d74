"""Scores of (question, chunk) pairs that are kept: a pair is scored once, whoever asks for it again.

The table is in segments (one a call that had something to score). A call joins its pairs with it, scores the rest in Arrow batches and adds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.segments import Segments

#: Pairs that a scorer is given at once.
BATCH = 256
#: A batch of questions and texts to a score each.
Scorer = Callable[[list[str], list[str]], list[float]]


class ScoreStore:
    def __init__(self, spark: SparkSession, path: str, scorer: Scorer):
        self.spark, self.scorer, self.segments = spark, scorer, Segments(spark, path, "id")

    def known(self) -> DataFrame:
        """(question, id, rerank_score) of all pairs that have been scored."""
        rows = self.segments.live("scores")
        return rows if rows is not None else self.spark.createDataFrame([], "question string, id string, rerank_score double")

    def count(self) -> int:
        """Times that the scorer was asked for a pair, over all calls."""
        return self.segments.state()["figures"].get("scored", 0)

    def scored(self, hits: DataFrame) -> DataFrame:
        """``hits`` (query_id, id, question, text, ...) with ``rerank_score``, null for null texts or questions. Pairs without a score are scored and kept first."""
        scorer, schema = self.scorer, T.StructType.fromDDL("question string, id string, rerank_score double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, BATCH):
                    part = batch.slice(lo, BATCH)
                    scores = scorer(part.column(0).to_pylist(), part.column(2).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1).cast(pa.string()), pa.array(scores, pa.float64())], names=schema.names)

        pairs = hits.where("question is not null and text is not null").groupBy("question", "id").agg(F.max("text").alias("text"))
        fresh = pairs.join(self.known(), ["question", "id"], "left_anti").select("question", "id", "text")
        was, segment = self.segments.state(), self.segments.begin()
        n = self.segments.put(segment, "scores", fresh.mapInArrow(run, schema)).count()
        if n:
            self.segments.commit(segment, was, {"scored": was["figures"].get("scored", 0) + n})
        return hits.join(self.known(), ["question", "id"], "left")

    def reranked(self, hits: DataFrame, k: int, pool: int | None = None) -> DataFrame:
        """The k best of each question's first ``pool`` hits."""
        chosen = self.scored(hits if pool is None else hits.where(F.col("rank") <= pool))
        order = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 4).desc_nulls_last(), F.col("rank"))
        return chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("rank").withColumnRenamed("place", "rank")
