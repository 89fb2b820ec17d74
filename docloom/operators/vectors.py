"""Vector search: exact inner products, with filters, an optional cell index, and comparison of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of a block: what one matrix product takes, and what every task is sent at once.
QUERY_BLOCK = 2_000
#: Scores that a step holds at once.
SCORES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-10)


def scored(vectors: DataFrame, queries: DataFrame, where: Column | None = None) -> DataFrame:
    """(query_id, vec_id, score): every vector that passes the filter against a stated block of queries."""
    block = queries.select("query_id", F.col("embedding").alias("query"), *[c for c in queries.columns if c not in ("query_id", "embedding")])
    base = vectors.where(where) if where is not None else vectors
    return base.join(F.broadcast(block), F.col("query_id") != F.col("vec_id")).withColumn("score", dot(F.col("embedding"), F.col("query")))


def mean_cosines(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, mean): a query's mean cosine similarity with all vectors but those of its own id.

    The mean of products is the product with the sum: vectors of length one are added up once, whatever the number of queries. A vector of length zero
    has the similarity zero; null vectors and ids count for nothing; vectors have one length.
    """
    base = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding", norm(F.col("embedding")).alias("length"))
    one = base.first()
    width = len(one.embedding) if one else 0
    part = lambda i: F.when(F.col("length") > 0, F.get("embedding", F.lit(i)) / F.col("length")).otherwise(0.0)
    sums = lambda df: df.agg(F.count("*").alias("n"), F.array(*(F.sum(part(i)) for i in range(width))).cast("array<double>").alias("sum"))
    asked = queries.where("query_id is not null and embedding is not null").select("query_id", F.col("embedding"))
    own = sums(base.join(asked.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi").groupBy("vec_id")).select(F.col("vec_id").alias("query_id"), F.col("n").alias("own_n"), F.col("sum").alias("own"))
    whole = asked.join(own, "query_id", "left").crossJoin(F.broadcast(sums(base)))  # one row
    rest = F.when(F.col("own").isNull(), F.col("sum")).otherwise(F.zip_with("sum", "own", lambda a, b: a - b))
    length = norm(F.col("embedding"))
    found = whole.select("query_id", (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("n"), F.when(length > 0, dot(F.col("embedding"), rest) / length).otherwise(0.0).alias("total"))
    return found.where("n > 0").groupBy("query_id").agg((F.sum("total") / F.sum("n")).alias("mean"))


def order_by(partition: str, then: str) -> Window:
    return Window.partitionBy(partition).orderBy(F.round("score", 9).desc(), F.col(then))


def first_of_each(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: greatest scores first, ties by id."""
    place = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((place, -score, query))
    sorted_query = query[order]
    starts = np.flatnonzero(np.r_[True, sorted_query[1:] != sorted_query[:-1]])
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[nth < k]


def block_hits(vectors: DataFrame, keys: list, matrix: np.ndarray, k: int, itself: bool, schema: T.StructType, groups: list | None = None) -> DataFrame:
    """Each task's k best vectors of every query of one block, by matrix products; with ``groups``, the queries', among the vectors of the same ``group``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    width = matrix.shape[1]
    names = np.array(keys, dtype=object)
    numbers = {g: i for i, g in enumerate(sorted({g for g in groups or () if g is not None}))}
    of = None if groups is None else np.array([numbers.get(g, -2) for g in groups])  # a null group is no other's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, score, ids = np.empty(0, int), np.empty(0), np.empty(0, object)
        least = np.full(len(keys), -np.inf)
        step = max(1, SCORES // len(keys))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                those = np.array(part.column(0).to_pylist(), dtype=object)
                rows = np.asarray(part.column(1).flatten(), dtype=float).reshape(-1, width)
                found = np.round(matrix @ rows.T, 9)
                if not itself:
                    found[names[:, None] == those[None, :]] = -np.inf
                if of is not None:
                    found[of[:, None] != np.array([numbers.get(g, -1) for g in part.column(2).to_pylist()])[None, :]] = -np.inf
                if len(those) > k:
                    least = np.maximum(least, np.partition(found, -k, axis=1)[:, -k])
                q, j = np.nonzero((found >= least[:, None]) & (found > -np.inf))
                query, score, ids = np.r_[query, q], np.r_[score, found[q, j]], np.r_[ids, those[j]]
                if len(query):
                    best = first_of_each(query, score, ids, k)
                    query, score, ids = query[best], score[best], ids[best]
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((names[query].tolist(), ids.tolist(), score), to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))

    return vectors.select("vec_id", "embedding", *([] if groups is None else ["group"])).mapInArrow(run, schema)


def in_blocks(queries: DataFrame, schema: T.StructType, each: Callable[[list, np.ndarray], DataFrame]) -> DataFrame:
    """What ``each(ids, matrix)`` finds for every block of queries (query_id, embedding), all together; queries without a vector find nothing."""
    out, keys, block = None, [], []

    def flush() -> None:
        nonlocal out, keys, block
        hits = each(keys, np.array(block, dtype=float))
        out = hits if out is None else out.unionByName(hits)
        keys, block = [], []

    for row in queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator():
        keys.append(row[0])
        block.append(row[1])
        if len(keys) == QUERY_BLOCK:
            flush()
    if keys:
        flush()
    return out if out is not None else queries.sparkSession.createDataFrame([], schema)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, itself: bool = True, same: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of greatest inner product, ties (to nine decimals) by id.

    Queries are a stated set. They are brought to the driver and sent out ``QUERY_BLOCK`` at a time; a task keeps k hits a query, and only
    these are shuffled. Without ``itself`` a query doesn't find the vector of its own id. With ``same``, a column of the vectors and one of the queries, a
    query finds vectors of its own value only (null is no value). Null vectors are skipped; vectors have one length.
    """
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    whole = vectors.where("vec_id is not null and embedding is not null")
    if same is None:
        out = in_blocks(queries, schema, lambda keys, matrix: block_hits(whole, keys, matrix, k, itself, schema))
    else:
        whole = whole.withColumn("group", F.col(same[0]))
        keyed = queries.where("embedding is not null").select(F.struct("query_id", F.col(same[1]).alias("group")).alias("query_id"), "embedding")
        out = in_blocks(keyed, schema, lambda keys, matrix: block_hits(whole, [x.query_id for x in keys], matrix, k, itself, schema, [x.group for x in keys]))
    return out.withColumn("rank", F.row_number().over(order_by("query_id", "vec_id"))).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, same: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of greatest inner product but the query's own, among those that pass the filter."""
    return nearest(vectors if where is None else vectors.where(where), queries, k, itself=False, same=same)


def sampled(vectors: DataFrame, n: int) -> DataFrame:
    """(cell, embedding): at most n of the vectors as centres, chosen by a hash of their ids."""
    return vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select(F.col("vec_id").alias("cell"), "embedding")
