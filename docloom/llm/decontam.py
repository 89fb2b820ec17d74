"""Benchmark decontamination: containment search by size-partitioned MinHash, verified exactly.

Items of up to eight shingles are looked up by each of them, exactly. Others are partitioned by size: one with n shingles is of the class of the next power of two u. For each class,
documents are read as windows of 2 u shingles, u apart, so that a passage of up to u shingles lies within one
window and its Jaccard similarity to it is bounded from below, however long the document is. Items and windows
have a MinHash signature, banded one by one; a hit makes (document, item) a candidate, and the share of the item's
distinct shingles that the whole document has, compared as words, decides. Windows' signatures are
minima over blocks, merged upwards from class to class: a shingle is hashed once, whatever the classes.

Items come in blocks of bounded size: one is collected, broadcast, searched for in all documents and dropped before the next, whose
findings are tables in the shared folder. Documents are never shuffled, but for ``clean`` with several blocks, an anti-join on texts' md5.

Defined cases: null and empty texts have no shingles and match nothing; an item of one to four words is one shingle
and found where a document has these words in a row; repeated rows of documents or items give repeated
results; an empty table on either side gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_rows, materialize, slices
from .shingles import WIDTH, flat_shingles, flat_words, words


@dataclass(frozen=True)
class Config:
    width: int = WIDTH
    containment: float = 0.8
    hashes: int = 40
    #: Items of so many shingles at most are looked up by each shingle's hash; signatures begin above.
    smallest_class: int = 8
    #: Bytes of item text that one broadcast holds, about.
    block_bytes: int = 2_000_000


class Index:
    """Items' exact shingles, and their signatures by class."""

    def __init__(self, items: list[tuple], config: Config = Config()):
        self.config = config
        self.items: list[tuple] = []  # (item id, exact shingles, sorted shingle hashes)
        self.short: dict[int, dict[bytes, list[int]]] = {}
        self.few: dict[int, list[int]] = {}
        rng = np.random.default_rng(5)
        self.mul = rng.integers(1, 1 << 63, config.hashes, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, config.hashes, np.uint64)
        by_class: dict[int, list[int]] = {}
        signatures = {}
        for item, text in items:
            found = words(text)
            if not found:
                continue
            at = len(self.items)
            if len(found) < config.width:
                self.items.append((item, {b" ".join(found)}, None))
                self.short.setdefault(len(found), {}).setdefault(b" ".join(found), []).append(at)
                continue
            exact = {b" ".join(found[i : i + config.width]) for i in range(len(found) - config.width + 1)}
            h = np.unique(flat_shingles(*flat_words([found]), config.width)[0])
            self.items.append((item, exact, h))
            if len(exact) <= config.smallest_class:
                for value in h.tolist():
                    self.few.setdefault(value, []).append(at)
                continue
            size = config.smallest_class
            while size < len(exact):
                size *= 2
            by_class.setdefault(size, []).append(at)
            signatures[at] = np.array([self._values(h, j).min() for j in range(config.hashes)], np.uint32)
        self.few_hashes = np.array(sorted(self.few), np.uint64)
        #: class -> for every hash: a filter by low bits, and signature value -> items
        self.classes = {}
        for size, members in sorted(by_class.items()):
            tables, filters = [], np.zeros((config.hashes, 1 << 16), bool)
            for j in range(config.hashes):
                table: dict[int, list[int]] = {}
                for at in members:
                    table.setdefault(int(signatures[at][j]), []).append(at)
                    filters[j, signatures[at][j] & 0xFFFF] = True
                tables.append(table)
            self.classes[size] = (filters, tables)

    def _values(self, h: np.ndarray, j: int) -> np.ndarray:
        return ((h * self.mul[j] + self.add[j]) >> np.uint64(32)).astype(np.uint32)

    def _candidates(self, h: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) for which some window and the item share a signature value in some place, or that share a shingle of an item of few."""
        out: set[tuple[int, int]] = set()
        if len(self.few):
            hits = np.flatnonzero(np.isin(h, self.few_hashes))
            for text, value in zip((np.searchsorted(starts, hits, "right") - 1).tolist(), h[hits].tolist(), strict=True):
                out.update((text, at) for at in self.few[value])
        if not len(h) or not self.classes:
            return out
        size = min(self.classes)
        counts = -(-np.diff(starts) // size)  # blocks of each text
        text = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        nth = np.arange(len(text)) - np.repeat(first, counts)
        edges = np.repeat(starts[:-1], counts) + nth * size
        minima = np.stack([np.minimum.reduceat(self._values(h, j), edges) for j in range(self.config.hashes)])
        while True:
            if size in self.classes:
                filters, tables = self.classes[size]
                follows = np.append(text[1:] == text[:-1], False)
                for j, (table, passes) in enumerate(zip(tables, filters, strict=True)):
                    low = minima[j].copy()
                    low[:-1] = np.where(follows[:-1], np.minimum(minima[j][:-1], minima[j][1:]), minima[j][:-1])
                    for w in np.flatnonzero(passes[low & 0xFFFF]).tolist():
                        for at in table.get(int(low[w]), ()):
                            out.add((int(text[w]), at))
            if size >= max(self.classes):
                return out
            even = np.flatnonzero(nth % 2 == 0)
            minima = np.minimum.reduceat(minima, even, axis=1)
            text, nth, size = text[even], nth[even] // 2, size * 2

    def search(self, texts: list) -> list[list[tuple]]:
        """For each text: (item id, shared shingles, shingles of the item) of each item that it contains."""
        out: list[list[tuple]] = [[] for _ in texts]
        width = self.config.width
        for lo, hi in slices(texts):
            lists = [words(t) for t in texts[lo:hi]]
            flat, bounds = flat_words(lists)
            h, places, starts = flat_shingles(flat, bounds, width)
            for text, at in sorted(self._candidates(h, starts)):
                item, exact, hashes = self.items[at]
                own = slice(starts[text], starts[text + 1])
                near = places[own][np.isin(h[own], hashes)] - bounds[text]
                shared = len({b" ".join(lists[text][p : p + width]) for p in near.tolist()} & exact)
                if shared >= self.config.containment * len(exact):
                    out[lo + text].append((item, shared, len(exact)))
            for size, table in self.short.items():
                for text, found in enumerate(lists):
                    for gram in {b" ".join(found[p : p + size]) for p in range(len(found) - size + 1)} & table.keys():
                        out[lo + text] += [(self.items[at][0], 1, 1) for at in table[gram]]
        return out


def _blocks(items: DataFrame, config: Config, item: str, text: str) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks, and the items block by block: the driver holds one, of bounded size."""
    rows = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // config.block_bytes)
    return n, ([tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()] for k in range(n))


def search(docs: DataFrame, items: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, shared, shingles, containment) of every document and item that it contains."""
    spark = docs.sparkSession
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}, shared int, shingles int, containment double"
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    n, blocks = _blocks(items, config, item, item_text)
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(Index(block, config))  # of at most block_bytes of text

        def step(index, keys, texts) -> Iterator[tuple]:
            for doc, found in zip(keys, index.search(texts), strict=True):
                yield from ((doc, at, m, size, m / size) for at, m, size in found)

        got = map_rows(rows, [key, "text"], schema, step, lambda shared=shared: shared.value)
        if n > 1:  # what a block finds is written before the next one is made, so that one is held at a time
            got = materialize(got, "contained")
            shared.destroy()
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, config: Config = Config(), text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item, with their own columns."""
    spark = docs.sparkSession
    n, blocks = _blocks(items, config, item, item_text)
    name = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    tainted = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(Index(block, config))  # of at most block_bytes of text
        if n == 1:
            return docs.where(~_holds(shared)(F.col(text).cast("string")))
        found = materialize(docs.where(_holds(shared)(F.col(text).cast("string"))).select(name.alias("name")).distinct(), "tainted")
        shared.destroy()
        tainted = found if tainted is None else tainted.unionByName(found)
    if tainted is None:
        return docs
    # texts decide, so rows of one id and different texts are told apart
    other = free_name(docs, "tainted")
    return docs.join(tainted.select(F.col("name").alias(other)), name == F.col(other), "left_anti")


def _holds(shared):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(found) for found in shared.value.search(list(texts))], dtype=bool)

    return holds
