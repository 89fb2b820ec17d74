"""Rank fusion, diversity, expansion and accumulation of retrieval hits.

Hits are (query_id, id, rank, score, ...), ranks from 1. Ties are broken by id everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def by_score(*partition: str, score: str = "score", then: str = "id"):
    return Window.partitionBy(*partition).orderBy(F.round(score, 9).desc(), F.col(then))


def rrf(vector: DataFrame, lexical: DataFrame, k: int = K) -> DataFrame:
    """(query_id, id, score, vector_score, sources, rank): the sum of 1 / (k + rank) over both lists; absent vector scores are 0."""
    a = vector.select("query_id", "id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    b = lexical.select("query_id", "id", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    sources = F.concat_ws("+", F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("bm25_rank").isNotNull(), "bm25"))
    fused = a.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", (part("vector_rank") + part("bm25_rank")).alias("score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), sources.alias("sources"))
    return fused.withColumn("rank", F.row_number().over(by_score("query_id")))


def padded(fused: DataFrame, vector: DataFrame, n: int) -> DataFrame:
    """The first n fused hits, filled up with the vector hits that aren't among them, in their order."""
    top = fused.where(F.col("rank") <= n).select("query_id", "id", F.lit(0).alias("part"), "rank")
    rest = vector.join(top.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", F.lit(1).alias("part"), "rank")
    order = Window.partitionBy("query_id").orderBy("part", "rank")
    return top.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("part")


def weighted_rrf(lists: DataFrame, original: float = 1.5, other: float = 1.0, k: int = K) -> DataFrame:
    """Fusion over the rewritten queries of one question: (query_id, variant, id, rank) with variant 0 the question itself."""
    weight = F.when(F.col("variant") == 0, original).otherwise(other)
    fused = lists.groupBy("query_id", "id").agg(F.sum(weight / (k + F.col("rank"))).alias("score"))
    return fused.withColumn("rank", F.row_number().over(by_score("query_id")))


def diversified(hits: DataFrame, most: int = 2, n: int | None = None) -> DataFrame:
    """At most ``most`` hits a file, in rank order; hits without a file are free, and most <= 0 switches it off.

    With ``n`` the skipped hits follow behind the kept ones, up to n.
    """
    file = Window.partitionBy("query_id", "filename").orderBy("rank")
    nth = F.row_number().over(file)
    kept = F.lit(True) if most <= 0 else (nth <= most) | (F.coalesce(F.col("filename"), F.lit("")) == "")
    marked = hits.withColumn("kept", kept)
    if n is None:
        return marked.where("kept").drop("kept")
    order = Window.partitionBy("query_id").orderBy(F.col("kept").desc(), F.col("rank"))
    return marked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("rank", "kept").withColumnRenamed("place", "rank")


def expanded(hits: DataFrame) -> DataFrame:
    """Small to big: a hit's text becomes its parent's; of hits with one parent the first stays; hits without a parent stay."""
    first = F.row_number().over(Window.partitionBy("query_id", "parent_content").orderBy("rank"))
    has = F.coalesce(F.col("parent_content"), F.lit("")) != ""
    return hits.withColumn("nth", first).where(~has | (F.col("nth") == 1)).withColumn("text", F.when(has, F.col("parent_content")).otherwise(F.col("text"))).drop("nth")


def accumulated(bank: DataFrame, new: DataFrame, refresh: bool = True) -> DataFrame:
    """The evidence bank after a round: new ids are added; known ones keep their place, and take the new score if ``refresh``."""
    both = bank.select("query_id", "id", "score", F.lit(0).alias("round")).unionByName(new.select("query_id", "id", "score", F.lit(1).alias("round")))
    pick = F.max_by("score", "round") if refresh else F.min_by("score", "round")
    return both.groupBy("query_id", "id").agg(pick.alias("score"), F.min("round").alias("since"))


def reranked(hits: DataFrame, scorer, k: int, pool: int | None = None) -> DataFrame:
    """The k best of the first ``pool`` hits by ``scorer(question, text)``, a column function. Each (question, text) is scored once.

    Without a scorer the first k stay.
    """
    if scorer is None:
        return hits.where(F.col("rank") <= k)
    chosen = hits if pool is None else hits.where(F.col("rank") <= pool)
    scores = chosen.select("question", "text").distinct().withColumn("rerank_score", F.round(scorer(F.col("question"), F.col("text")), 4))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("rank"))
    return chosen.join(scores, ["question", "text"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("rank").withColumnRenamed("place", "rank")


def lexical_scorer(question, text):
    """A deterministic scorer: the share of the question's words that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), 0))
    asked = words(question)
    return F.size(F.array_intersect(asked, words(text))) / F.greatest(F.size(asked), F.lit(1))
