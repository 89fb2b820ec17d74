"""Caches as tables: expiry, exact and semantic lookup, and the replay of a least-recently-used cache over an access log."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .vectors import SCORES, in_blocks


def alive(entries: DataFrame, now: Column) -> DataFrame:
    """Entries that haven't expired; without an expiry they never do."""
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def exact(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """(request columns, value): the value of an equal key, null on a miss."""
    return requests.join(entries.select("key", "value"), "key", "left")


def semantic(requests: DataFrame, entries: DataFrame, least: float = 0.85) -> DataFrame:
    """(query_id, key): the first inserted entry whose embedding has at least this cosine, ties by key; misses have no row.

    Requests go out in blocks, entries are scanned once a block as matrix products; a task hands on one entry a request.
    """
    kind = {c: entries.schema[c].dataType for c in ("inserted_at", "key")}
    schema = T.StructType([T.StructField("query_id", requests.schema["query_id"].dataType), *(T.StructField(c, kind[c]) for c in kind)])
    whole = entries.where("key is not null and embedding is not null").select("inserted_at", "key", "embedding")

    def first(keys: list, matrix: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            size = np.linalg.norm(matrix, axis=1)
            for batch in batches:
                for lo in range(0, batch.num_rows, step := max(1, SCORES // len(keys))):
                    part = batch.slice(lo, step)
                    rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                    order = sorted(range(len(rows)), key=lambda j: (rows[j][0] is not None, *rows[j]))
                    x = np.asarray(part.column(2).flatten(), dtype=float).reshape(len(rows), -1)[order]
                    near = matrix @ x.T >= least * (size[:, None] * np.linalg.norm(x, axis=1) + 1e-10)
                    at = near.argmax(axis=1)
                    for q in np.flatnonzero(near[np.arange(len(keys)), at]).tolist():
                        this = rows[order[at[q]]]
                        if q not in best or (this[0] is not None, *this) < (best[q][0] is not None, *best[q]):
                            best[q] = this
            if best:
                cells = [[keys[q] for q in best], *zip(*best.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cells, to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))

        return whole.mapInArrow(run, schema)

    return in_blocks(requests, schema, first).groupBy("query_id").agg(F.min_by("key", F.struct("inserted_at", "key")).alias("key"))


def replay(log: DataFrame, maxsize: int, ttl: float | None) -> DataFrame:
    """(cache, at, key, hit) of each access (cache, at, key) in order; one cache's log is folded at a time."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict = OrderedDict()
        hits = []
        pdf = pdf.sort_values(["at", "key"])
        for at, key in zip(pdf["at"], pdf["key"], strict=True):
            fresh = key in held and (not ttl or held[key] > at)
            hits.append(fresh)
            if fresh:
                held.move_to_end(key)
            else:
                held.pop(key, None)
                held[key] = at + (ttl or 0)
                if len(held) > maxsize:
                    held.popitem(last=False)
        return pdf.assign(hit=hits)[["cache", "at", "key", "hit"]]

    return log.groupBy("cache").applyInPandas(fold, "cache string, at double, key string, hit boolean")
