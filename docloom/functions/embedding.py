"""Embeddings as a column function: a model given by the caller, or hashed words of unit length."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


def hashed_words(texts: list[str], dimension: int = 64) -> np.ndarray:
    out = np.zeros((len(texts), dimension))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % dimension] += 1 if h >> 16 & 1 else -1
    return out


def embed(text: Column, model: Callable[[list[str]], np.ndarray] = hashed_words, prefix: str = "", batch: int = 64) -> Column:
    """Vectors of length 1 of the texts, in batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        found = [prefix + (t or "") for t in texts]
        rows: list = []
        for i in range(0, len(found), batch):
            v = np.asarray(model(found[i : i + batch]), float)
            rows += list((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32))
        return pd.Series(rows, index=texts.index)

    return run(text)
