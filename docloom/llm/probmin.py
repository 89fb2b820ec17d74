"""Near duplicates by ProbMinHash over weighted word shingles.

A text is the weighted set of its shingles of five words, with weights 2 count / (count + 1), which lie between 1 and 2. Each shingle is a Poisson process of
its weight's rate whose arrivals fall on registers at random; a register keeps the earliest arrival's shingle. Arrivals later
than every register's are never drawn (early termination). Two texts agree in a register with the probability Jaccard
similarity of their weights (the probability is exact, ``probability_jaccard`` computes it), whatever their lengths. Registers are banded; texts of one bucket are compared with the bucket's
pivots only, a few at first and more in each further round among those that no pivot has linked, so a bucket of any size
costs its members times its distinct kinds; four bits of every register sieve the pairs within that join. What passes is
verified exactly: Jaccard similarity of the shingle sets of at least the threshold. Repeat counts change a weight by a factor
under two, so that the two similarities stay close however often a phrase is said, and the sieve leaves room for what they differ by
(``Config.sieve``). Classes are the connected components; equal texts are one node from the start.

Defined cases: null counts as empty text; texts without words are near nothing but equal texts; texts of one to four words
are one shingle; repeated rows and ids are copies like any other; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_rows, materialize, remove, shared_dir
from .graph import components, star_links
from .shingles import WIDTH, flat_shingles, flat_words, mixed, words

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Config:
    width: int = WIDTH
    similarity: float = 0.8
    #: Probability Jaccard similarity that the sieve lets pass but for one pair in 100,000: of pairs at the threshold whose repeat counts differ.
    sieve: float = 0.7
    bands: int = 26
    rows: int = 5
    #: Texts of a bucket from which on it is asked first which shingles each has alone.
    hot: int = 32

    @property
    def registers(self) -> int:
        return self.bands * self.rows


# signatures ------------------------------------------------------------------------------------


def weighted(texts: list, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, counts, text of each), by text and then by shingle."""
    flat, bounds = flat_words([words(t) for t in texts])
    h, _, starts = flat_shingles(flat, bounds, width)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    sizes = np.diff(bounds)
    brief = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(brief):  # a shingle of all the words
        extra = np.zeros(len(brief), np.uint64)
        for i, t in enumerate(brief.tolist()):
            for w in flat[bounds[t] : bounds[t + 1]].tolist():
                extra[i] = mixed(extra[i : i + 1] * _GOLDEN + np.uint64(w + 1))[0]
        h, text = np.concatenate([h, extra]), np.concatenate([text, brief])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), text[at]


def signatures(h: np.ndarray, weight: np.ndarray, text: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers): the shingle that arrives first in each register; 0 in texts without shingles."""
    earliest = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    t, w = np.zeros(len(h)), weight.astype(np.float64)
    step = 0
    while len(h):
        step += 1
        draw = mixed(h + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        register = ((mixed(draw ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        at = text * registers + register
        first = t < earliest[at]
        at, found, own = at[first], t[first], h[first]
        np.minimum.at(earliest, at, found)
        best = earliest[at] == found
        winner[at[best]] = own[best]
        latest = earliest.reshape(n, registers).max(axis=1)
        live = t < latest[text]
        h, t, w, text = h[live], t[live], w[live], text[live]
    return winner.reshape(n, registers)


LANE_BITS = 4
LANES = 64 // LANE_BITS
#: Longs of a text's parities.
PARITIES = 8


def parities(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n, PARITIES): each bit tells whether the distinct shingles that fall on it are odd in number. Only a shingle that one of two texts has alone can make
    them differ in a bit, so they have as many such shingles at least as they differ in bits."""
    bit = h >> np.uint64(64 - (PARITIES * 64 - 1).bit_length())
    out = np.zeros(n * PARITIES, np.uint64)
    np.bitwise_xor.at(out, text * PARITIES + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, PARITIES)


def sketches(texts: list, config: Config = Config()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((n, bands) of bucket keys, (n, longs) of four bits a register and then of parities, distinct shingles of each text)."""
    h, counts, text = weighted(texts, config.width)
    winners = signatures(h, saturated(counts), text, len(texts), config.registers)
    rows = winners.reshape(len(texts), config.bands, config.rows)
    keys = np.broadcast_to(np.arange(1, config.bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(config.rows):
        keys = mixed(keys * _GOLDEN + rows[:, :, r])
    longs = -(-config.registers // LANES)
    lanes = np.zeros((len(texts), longs * LANES), np.uint64)
    lanes[:, : config.registers] = mixed(winners) & np.uint64(15)
    packed = np.zeros((len(texts), longs), np.uint64)
    for i in range(LANES):
        packed |= lanes[:, i::LANES] << np.uint64(LANE_BITS * i)
    packed = np.concatenate([packed, parities(h, text, len(texts))], axis=1)
    return keys.astype(np.int64), packed.astype(np.int64), np.bincount(text, minlength=len(texts))


def alike(config: Config) -> Callable[[str, str], Column]:
    """A condition on two sketches that texts of the probability Jaccard similarity ``sieve`` fail with a probability under one in 100,000,
    and on what two texts can have in common at most and alone at least, which no link fails."""
    p = config.sieve + (1 - config.sieve) / 16
    least = config.registers * p - 4.4 * (config.registers * p * (1 - p)) ** 0.5

    def condition(m: str, q: str) -> Column:
        differ = F.lit(0)
        for i in range(-(-config.registers // LANES)):
            x = F.col(f"{m}k{i}").bitwiseXOR(F.col(f"{q}k{i}"))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
            differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
        # shingles that a text alone of all texts in hot buckets has are no other such text's
        both = F.least(*(F.col(f"{t}size") - F.when(F.col(f"{m}hot") & F.col(f"{q}hot"), F.col(f"{t}own")).otherwise(0) for t in (m, q)))
        sizes = F.col(f"{m}size") + F.col(f"{q}size")
        alone = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{m}x{i}").bitwiseXOR(F.col(f"{q}x{i}"))) for i in range(PARITIES)))
        return (both >= common(sizes, config)) & (alone <= sizes - 2 * common(sizes, config)) & (differ <= int(config.registers - least))

    return condition


def common(sizes: Column, config: Config) -> Column:
    """Shingles that two texts with so many together have in common at least if they are near."""
    return F.lit(config.similarity / (1 + config.similarity)) * sizes - 1e-6


def saturated(counts: np.ndarray) -> np.ndarray:
    """Weights that a shingle repeated hundreds of times does not rule: 2 count / (count + 1), from 1 to under 2."""
    return 2.0 * counts / (counts + 1.0)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """What registers estimate: probability Jaccard of two sorted (shingles, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    only_a, only_b = float(a[1].sum() - x.sum()), float(b[1].sum() - y.sum())
    # for the shingle d: the sum over all e of max(x_e / x_d, y_e / y_d); e counts by x where its ratio is at least d's
    start = np.searchsorted(ratio, ratio, "left")
    from_x = np.append(np.cumsum(x[::-1])[::-1], 0.0)[start] + only_a
    from_y = np.append(0.0, np.cumsum(y))[start] + only_b
    return float((1 / (from_x / x + from_y / y)).sum())


# tables ----------------------------------------------------------------------------------------


def nodes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, node, text): a node is a distinct text, named by its md5."""
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), F.unhex(F.md5(clean.cast("binary"))).alias("node"), clean.alias("text"))


def signed(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """(node, keys, size, k0, k1, ..., x0, x1, ...) of every distinct text with shingles. A task does each of its distinct texts once."""
    longs = -(-config.registers // LANES)

    def step(seen, names, texts) -> Iterator[tuple]:
        fresh = {}
        for name, text in zip(names, texts, strict=True):
            if name not in seen:
                seen.add(name)
                fresh[name] = text
        if fresh:
            keys, packed, sizes = sketches(list(fresh.values()), config)
            for name, row, sketch, size in zip(fresh, keys.tolist(), packed.tolist(), sizes.tolist(), strict=True):
                if size:
                    yield name, row, size, *sketch

    lanes = [f"k{i}" for i in range(longs)] + [f"x{i}" for i in range(PARITIES)]
    found = map_rows(rows, ["node", "text"], "node binary, keys array<bigint>, size long, " + ", ".join(f"{k} long" for k in lanes), step, set)
    return found.groupBy("node").agg(F.first("keys").alias("keys"), *(F.first(k).alias(k) for k in ("size", *lanes)))


def unshared(texts: DataFrame, config: Config = Config()) -> DataFrame:
    """(id, own): how many of its shingles each text (id, text) has alone; texts without any are absent."""

    def step(ids, texts) -> Iterator[tuple]:
        h, _, text = weighted(texts, config.width)
        cells = np.split(h.astype(np.int64), np.searchsorted(text, np.arange(1, len(texts))))
        return zip(ids, (c.tolist() for c in cells), strict=True)

    each = map_rows(texts, ["id", "text"], "id long, shingles array<bigint>", step).select("id", F.explode("shingles").alias("h"))
    # a text has a shingle once, so one that only one text has has one least and one greatest id
    alone = each.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return alone.groupBy("id").agg(F.count("*").alias("own"))


def verified(pairs: DataFrame, texts: DataFrame, config: Config = Config()) -> DataFrame:
    """(a, b, near) of every pair of nodes. The pivot's side comes sorted, so its shingles are made once a run of rows."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    whole = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def step(held, a, b, text_a, text_b) -> Iterator[tuple]:
        def cell(text) -> np.ndarray:
            return weighted([text], config.width)[0]

        for p, q, s, t in zip(a, b, text_a, text_b, strict=True):
            if held.get("node") != q:
                held["node"], held["cell"] = q, cell(t)
            yield p, q, similarity(cell(s), held["cell"]) >= config.similarity

    return map_rows(whole, ["a", "b", "text_a", "text_b"], "a binary, b binary, near boolean", step, dict)


def links(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """(a, b): verified links between distinct texts, enough to connect each class."""
    spark = rows.sparkSession
    shared_dir(spark)
    signs = materialize(signed(rows, config), "signatures")
    bands = signs.select(F.explode("keys").alias("bucket"), "node", "size")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("size").alias("least")).where("n > 1")
    crowded = materialize(bands.drop("size").join(sizes, "bucket"), "crowded")
    # a text that meets many others is a likely centre, and comes first as a pivot
    ranks = materialize(crowded.groupBy("node").agg(F.sum("n").alias("rank"), (F.max("n") > config.hot).alias("hot")), "ranks")
    # one text a node: copies meet in the tasks that read them, before any exchange
    texts = materialize(rows.groupBy("node").agg(F.first("text").alias("text")).join(ranks.select("node", "hot"), "node").withColumn("id", F.monotonically_increasing_id()), "texts")
    own = texts.where("hot").select("id", "node").join(unshared(texts.where("hot"), config), "id").select("node", "own")
    known = ranks.join(signs.drop("keys"), "node").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # all texts of a hot bucket are hot: one that has too much alone to be near even the shortest of them leaves the bucket
    able = (F.col("n") <= config.hot) | (F.col("size") - F.col("own") >= common(F.col("size") + F.col("least"), config))
    active = materialize(crowded.join(known, "node").where(able).drop("n", "least"), "members")
    found = star_links(active, lambda pairs: verified(pairs, texts, config), alike(config))
    for df in (signs, crowded, ranks, active, texts):
        remove(df)
    return found if found is not None else spark.createDataFrame([], "a binary, b binary")


def class_map(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """(node, class_id, class_size, first_id, first_node): every distinct text's class; the class is named by its least id."""
    linked = links(rows, config)
    labels = components(linked)
    own = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("node").alias("of"))).alias("first"), F.count("*").alias("n"))
    known = materialize(own.join(labels, "node", "left").select("node", "first", "n", F.coalesce("label", "node").alias("label")), "known")
    remove(labels)
    remove(linked)
    classes = known.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    return known.select("node", "label").join(classes, "label").select("node", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first.of").alias("first_node"))


def classes(docs: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, class_size) of every row: rows of one class are near duplicates of one another."""
    rows = nodes(docs, key, text)
    found = class_map(rows, config)
    return rows.select("doc_id", "node").join(found, "node").select(F.col("doc_id").alias(key), "class_id", "class_size")


def keep_one(docs: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that of the least id, with its own columns."""
    rows = nodes(docs, key, text)
    own, first, of = (free_name(docs, c) for c in ("node", "first_id", "first_node"))
    kept = class_map(rows, config).select(F.col("class_id").alias(first), F.col("first_node").alias(of)).distinct()
    named = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))))
    near = named.join(kept, F.col(key).eqNullSafe(F.col(first)) & (F.col(own) == F.col(of)), "left_semi")
    return near.dropDuplicates([key, own]).drop(own)
