"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text are hashed unigrams and bigrams of its words and of the words' shapes (letters by
case, digits, runs of marks; whether a word repeats the one before), each weighted by its share of the
text, so that length alone says nothing. Training makes ``epochs`` FTRL-proximal passes over a bounded sample of labelled rows; scoring is
a sparse dot product of a text's feature counts with the weights, which are broadcast: their size is
fixed by ``2 ** bits``.

Defined cases: a null text scores as an empty one, an empty text by the bias alone; rows without a label
are scored but never learnt from; a repeated row is scored each time; without labelled rows every
score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .tokens import release

#: Words and runs of marks, in UTF-8.
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\s]+")
SHAPE = re.compile(rb"[aA9]+|[^aA9\s]+")
#: Letters by case and digits, for shapes; bytes beyond ASCII count as small letters.
CLASSES = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c for c in range(256))
RUNS = re.compile(rb"(?<=aa)a+|(?<=AA)A+|(?<=99)9+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The weights of a text's features sum to this.
SCALE = 40.0


@dataclass(frozen=True)
class Config:
    bits: int = 18
    #: Labelled rows to learn from, at most: those of the lowest hash of their id.
    sample: int = 6_000
    #: Passes over the sample.
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.0001
    l2: float = 0.0001
    threshold: float = 0.3


def mixed(values: np.ndarray, bits: int) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * MIX
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def hashed(text: str | None, bits: int) -> np.ndarray:
    """A feature index for every n-gram of the text, repeats included."""
    data = (text or "").encode("utf-8", "surrogatepass")
    tokens = TOKEN.findall(data.lower())
    if not tokens:
        return np.empty(0, np.int64)
    crc = zlib.crc32
    words = np.fromiter(map(crc, tokens), np.uint64, len(tokens))
    marks = SHAPE.findall(RUNS.sub(b"", data.translate(CLASSES)))
    shapes = np.fromiter(map(crc, marks), np.uint64, len(marks))
    grams = [words, shapes ^ np.uint64(1 << 40)]
    if len(words) > 1:
        same = words[:-1] == words[1:]
        grams += [(words[:-1] << np.uint64(31)) ^ words[1:] ^ np.uint64(1 << 62), same.astype(np.uint64) ^ np.uint64(1 << 41)]
    if len(shapes) > 1:
        grams.append((shapes[:-1] << np.uint64(31)) ^ shapes[1:] ^ np.uint64(3 << 62))
    return mixed(np.concatenate(grams), bits)


class Ftrl:
    """FTRL-proximal for logistic loss over sparse rows."""

    def __init__(self, config: Config):
        self.config = config
        size = (1 << config.bits) + 1  # the last is the bias
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        c, z = self.config, self.z[at]
        w = -(z - np.sign(z) * c.l1) / ((c.beta + np.sqrt(self.n[at])) / c.alpha + c.l2)
        return np.where(np.abs(z) <= c.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.config.alpha * w
        self.n[at] = n + g * g


def row(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features with their weights: shares of the text, times SCALE; and the bias."""
    grams = hashed(text, bits)
    at, counts = np.unique(grams, return_counts=True)
    return np.append(at, 1 << bits).astype(np.int32), np.append(counts * (SCALE / max(1, len(grams))), 1.0).astype(np.float32)


def fit(texts: list, labels: list, config: Config = Config()) -> np.ndarray:
    """Weights as float32, the bias last."""
    model = Ftrl(config)
    rows = [row(t, config.bits) for t in texts]
    order = np.random.default_rng(7)
    for _ in range(config.epochs):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i], float(labels[i]))
    return model.weights().astype(np.float32)


def score_texts(texts: list, weights: np.ndarray, bits: int) -> list[float]:
    out = []
    for text in texts:
        grams = hashed(text, bits)
        z = float(weights[-1]) + SCALE * float(weights[grams].sum(dtype=np.float64)) / max(1, len(grams))
        out.append(1 / (1 + math.exp(-min(35.0, max(-35.0, z)))))
    return out


def train(docs: DataFrame, labels: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Learns on the ``config.sample`` labelled rows whose ids hash lowest; one task does it, as its input is bounded."""
    ids = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = ids.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(config.sample)  # bounded by config.sample
    known = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key).groupBy(key).agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def learn(frames) -> Iterator:
        got = [frame for frame in frames if len(frame)]
        if not got:
            return
        got = pd.concat(got, ignore_index=True).sort_values(key, kind="stable")
        yield pd.DataFrame({"weights": [fit(list(got["text"]), list(got["y"]), config).tobytes()]})

    found = known.coalesce(1).mapInPandas(learn, "weights binary").collect() if chosen.limit(1).count() else []
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << config.bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, config: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** bits + 1 floats
    kind = docs.schema[key].dataType.simpleString()
    bits, threshold = config.bits, config.threshold

    def step(keys, texts) -> Iterator[tuple]:
        scores = score_texts(texts, shared.value, bits)
        return ((k, s, int(s >= threshold)) for k, s in zip(keys, scores, strict=True))

    return map_rows(docs.select(F.col(key), F.col(text).cast("string").alias("text")), [key, "text"], f"`{key}` {kind}, score double, predicted int", step)


def keep_good(docs: DataFrame, labels: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that the classifier accepts, with their own columns. Scores are matched by the row's text, not by a join."""
    weights = train(docs, labels, config, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    bits, threshold = config.bits, config.threshold

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series(score_texts(list(texts), shared.value, bits))

    return docs.where(scored(F.col(text)) >= F.lit(threshold))
