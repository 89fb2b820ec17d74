"""Language-model scores by word classes: a Brown class bigram model whose classes come from exchange clustering.

A token's probability is that of its class after the class before, times that of the word within its class:
p(w | v) = p(c(w) | c(v)) p(w | c(w)). A text is its words (A-Z lowered, split at ASCII white space) and one end, which has
a class of its own and is the state that a text starts from.

Training counts every word and every pair of neighbours of the training documents. What is clustered are units: each word that makes up
``unit_share`` of the tokens or more (there are at most ``1 / unit_share``), and the rarer words in groups by their last three bytes. A pass
of the exchange lets half of the units, in turn, move to the class that raises the likelihood of the class bigrams most: units are dealt
over tasks, a task keeps its own copy of the class table up to date as its units move, and the tables are summed anew after each pass, so
a pass that lowers the likelihood is undone. Class rows are smoothed by absolute discounting towards class frequencies, words within a
class by a discount that goes to the one unknown word; over known words and the unknown one probabilities sum to 1.

Counts of words of ``known_share`` of the tokens or more (at most ``1 / known_share`` words) are sent to all tasks; the others' meet the
documents' rarer words in a join. Nothing is left out of any count.

Defined cases: null and empty texts are one end; a null id counts as an empty one, so such rows are training rows; repeated
rows count and score each; very long texts are read whole; without training rows every word is unknown; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_rows, materialize, remove, slices

#: Ends a text; no word holds a space.
END = b" "
#: Distinct entries that a task's counter holds before it hands them on.
HELD = 300_000


@dataclass(frozen=True)
class Config:
    classes: int = 64
    #: Words of this share of the tokens or more are clustered each for itself.
    unit_share: float = 2**-15
    #: Groups of the rarer words.
    groups: int = 1_024
    #: Words of this share or more are sent to all tasks.
    known_share: float = 2**-20
    passes: int = 6
    #: Of class bigrams.
    discount: float = 0.5


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def texts(docs: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def words(data: bytes) -> list[bytes]:
    return data.lower().split()


class Units(dict):
    """Word -> unit; words without an entry belong to the group of their last three bytes."""

    def __init__(self, entries: Iterable, groups: int):
        super().__init__(entries)
        self.first, self.groups = len(self), groups

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word[-3:]) % self.groups


def group_of(word: Column, groups: int) -> Column:
    """As ``Units`` has it, from 0."""
    return F.crc32(F.when(F.length(word) > 3, F.substring(word, -3, 3)).otherwise(word)) % groups


def counted(docs: DataFrame, column: str, schema: str, entries) -> DataFrame:
    """Rows of what ``entries(texts of a slice)`` gives a counter; a task adds up before it hands on."""
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held = arrow_schema(out), Counter()

        def rows() -> pa.RecordBatch:
            keys = zip(*held.keys(), strict=True) if len(kind) > 2 else [held.keys()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip([*keys, held.values()], kind, strict=True)], schema=kind)

        for batch in batches:
            cells = batch.column(0).to_pylist()
            for lo, hi in slices(cells):
                entries(held, cells[lo:hi])
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return docs.select(column).mapInArrow(run, out)


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n) of all training tokens, ends included; ``train`` has the text as bytes."""

    def entries(held: Counter, data: list[bytes]) -> None:
        for t in data:
            held.update(words(t))
        held[END] += len(data)

    return counted(train, "__text", "word binary, n long", entries).groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(train: DataFrame, units: Units) -> DataFrame:
    """(a, b, n): how often unit b follows unit a; a text starts and ends with the end."""
    shared, size = train.sparkSession.sparkContext.broadcast(units), units.first + units.groups

    def entries(held: Counter, data: list[bytes]) -> None:
        unit = shared.value.__getitem__
        end = unit(END)
        flat = [end]
        for t in data:
            flat += map(unit, words(t))
            flat.append(end)
        flat = np.array(flat, np.int64)
        codes, n = np.unique(flat[:-1] * size + flat[1:], return_counts=True)
        held.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))

    pairs = counted(train, "__text", "pair long, n long", entries).groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select(F.floor(F.col("pair") / size).cast("int").alias("a"), (F.col("pair") % size).cast("int").alias("b"), "n")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(unit, near): for each unit its neighbours as (unit, times it follows, times it goes before); as many as there are units at most."""
    after = pairs.select(F.col("a").alias("unit"), F.col("b").alias("of"), F.col("n").alias("out"), F.lit(0).cast("long").alias("into"))
    before = pairs.select(F.col("b").alias("unit"), F.col("a").alias("of"), F.lit(0).cast("long").alias("out"), F.col("n").alias("into"))
    both = after.unionByName(before).groupBy("unit", "of").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return both.groupBy("unit").agg(F.collect_list(F.struct("of", "out", "into")).alias("near"))


def xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def likelihood(table: np.ndarray) -> float:
    """The part of the class bigrams' log likelihood that depends on the classes."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum())


def best_class(table: np.ndarray, out: np.ndarray, into: np.ndarray, loops: float) -> int:
    """Where a unit goes that is in no class now: ``out`` and ``into`` are its counts with each class, ``loops`` with itself. Class 0 is the end's."""
    # a class's own totals hold its pairs with the unit wherever that goes
    rows, columns = table.sum(axis=1) + into, table.sum(axis=0) + out
    o, i = np.flatnonzero(out), np.flatnonzero(into)
    gain = (xlogx(table[:, o] + out[o]) - xlogx(table[:, o])).sum(axis=1) + (xlogx(table[i] + into[i, None]) - xlogx(table[i])).sum(axis=0)
    at = table.diagonal()
    gain += xlogx(at + out + into + loops) - xlogx(at + out) - xlogx(at + into) + xlogx(at)
    gain -= xlogx(rows + out.sum() + loops) - xlogx(rows) + xlogx(columns + into.sum() + loops) - xlogx(columns)
    gain[0] = -np.inf
    return int(gain.argmax())


def exchange(units: list[int], near: list[np.ndarray], classes: np.ndarray, table: np.ndarray) -> list[int]:
    """The class of each unit after it moved where the likelihood is greatest, one after another; ``classes`` and ``table`` are kept up to date."""
    moved, k = [], len(table)
    for u, n in zip(units, near, strict=True):
        itself = n[:, 0] == u
        loops, others = float(n[itself, 1].sum()), n[~itself]
        c = classes[others[:, 0]]
        out, into = np.bincount(c, others[:, 1], k), np.bincount(c, others[:, 2], k)
        was = classes[u]
        table[was] -= out
        table[:, was] -= into
        table[was, was] -= loops
        to = best_class(table, out, into, loops)
        table[to] += out
        table[:, to] += into
        table[to, to] += loops
        classes[u] = to
        moved.append(to)
    return moved


def class_table(pairs: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Class bigram counts: a task adds up its pairs, k * k numbers meet."""
    shared, schema = pairs.sparkSession.sparkContext.broadcast(classes), T.StructType.fromDDL("a int, b int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            a, b, n = (np.asarray(c) for c in batch.columns)
            np.add.at(total, shared.value[a] * k + shared.value[b], n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some // k, pa.int32()), pa.array(some % k, pa.int32()), pa.array(total[some])], schema=arrow_schema(schema))

    found = np.zeros((k, k))
    for r in pairs.mapInArrow(run, schema).groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        found[r.a, r.b] = r.n
    return found


def moves(near: DataFrame, classes: np.ndarray, table: np.ndarray, half: int) -> np.ndarray:
    """The classes after one pass in which every other unit moves."""
    shared, schema = near.sparkSession.sparkContext.broadcast((classes, table)), T.StructType.fromDDL("unit int, class int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = (x.copy() for x in shared.value)
        for batch in batches:
            units = batch.column(0).to_pylist()
            near = batch.column(1)
            ends, cells = np.asarray(near.offsets), [np.asarray(c) for c in near.flatten().flatten()]
            rows = np.stack(cells, axis=1)
            lists = [rows[lo - ends[0] : hi - ends[0]] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            to = exchange(units, lists, now, counts)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(to, pa.int32())], schema=arrow_schema(schema))

    after = classes.copy()
    for r in near.where((F.col("unit") > 0) & (F.col("unit") % 2 == half)).mapInArrow(run, schema).collect():  # a row a unit, of which there are 1 / unit_share + groups at most
        after[r.unit] = r[1]
    return after


def cluster(pairs: DataFrame, n_units: int, config: Config) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each unit, class bigram counts, likelihood after each pass). Unit 0 is the end; units come by falling count."""
    k = config.classes
    classes = np.r_[0, 1 + np.arange(n_units - 1) % (k - 1)].astype(np.int64)
    near = materialize(neighbours(pairs), "brown-near")
    try:
        table = class_table(pairs, classes, k)
        seen = [likelihood(table)]
        for turn in range(config.passes):
            after = moves(near, classes, table, turn % 2)
            counts = class_table(pairs, after, k)
            if likelihood(counts) > seen[-1]:
                classes, table = after, counts
            seen.append(likelihood(table))
    finally:
        remove(near)
    return classes, table, seen


@dataclass(frozen=True)
class Model:
    """Everything a task needs to score a text but the counts of rare words: sizes are bounded by ``Config``."""

    config: Config
    tokens: int
    distinct: int
    #: Count of each known word, of its unit, and the units of all words.
    known: dict[bytes, int]
    units: Units
    classes: np.ndarray
    #: log10 of class after class; per class log10 of its tokens and one more, and of its unknown word.
    transitions: np.ndarray
    sizes: np.ndarray
    unknown: np.ndarray
    word_discount: float
    likelihoods: list[float]


def transitions(table: np.ndarray, discount: float) -> np.ndarray:
    """log10 p(class | class before)."""
    rows, alone = table.sum(axis=1, keepdims=True), (table.sum(axis=0) + 1) / (table.sum() + len(table))
    kept = np.maximum(table - discount, 0)
    p = np.where(rows > 0, (kept + np.minimum(table, discount).sum(axis=1, keepdims=True) * alone) / np.maximum(rows, 1), alone)
    return np.log10(p)


def learn(train: DataFrame, counts: DataFrame, config: Config = Config()) -> Model:
    """``train`` has the texts as bytes, ``counts`` is ``word_counts`` of them, stored."""
    figures = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    least = lambda share: max(1, int(np.ceil(figures.tokens * share)))
    own, sent = least(config.unit_share), least(config.known_share)
    # at most 1 / known_share words
    held = counts.where((F.col("n") >= sent) | (F.col("word") == F.lit(END))).toArrow()
    known = dict(sorted(zip(held["word"].to_pylist(), held["n"].to_pylist(), strict=True), key=lambda e: (-e[1], e[0])))
    frequent = [w for w, n in known.items() if n >= own and w != END]
    units = Units(((w, i) for i, w in enumerate([END, *frequent])), config.groups)
    pairs = materialize(pair_counts(train, units), "brown-pairs")
    try:
        classes, table, seen = cluster(pairs, units.first + config.groups, config)
    finally:
        remove(pairs)
    distinct = np.zeros(config.classes)
    np.add.at(distinct, classes[: units.first], 1)
    rare = counts.where((F.col("n") < own) & (F.col("word") != F.lit(END))).groupBy(group_of(F.col("word"), config.groups).alias("g")).agg(F.count("*").alias("d"))
    for r in rare.collect():  # a row a group
        distinct[classes[units.first + r.g]] += r.d
    spare = figures.once / (figures.once + 2 * figures.twice) if figures.once else 0.5
    spare = float(min(0.9, max(0.1, spare)))
    tokens = table.sum(axis=0)
    return Model(config, figures.tokens, figures.distinct, known, units, classes, transitions(table, config.discount), np.log10(tokens + 1), np.log10(distinct * spare + 1), spare, seen)


class Scorer:
    """Scores texts; what depends on the count of a word that isn't known here is left open and handed out as (word, times, log10 of its class's unknown word)."""

    def __init__(self, model: Model):
        m = self.model = model
        self.at = {w: i for i, w in enumerate(m.known)}
        n = np.array([*m.known.values(), 0], float)
        unit = np.array([*(m.units[w] for w in m.known), 0], np.int64)
        self.classes = m.classes[unit]
        self.base, self.word = np.log10(n + 1), np.log10(np.maximum(n - m.word_discount, 1e-9))
        self.least = np.log10(m.tokens + m.distinct + 1)

    def text(self, data: bytes) -> tuple[int, int, float, float, list[dict]]:
        """(tokens, known ones, base score, score, what is open)."""
        m, get, found = self.model, self.at.get, words(data)
        at = np.array([get(w, -1) for w in found], np.int64)
        rare = np.flatnonzero(at < 0)
        classes = self.classes[at]
        classes[rare] = m.classes[np.array([m.units[found[i]] for i in rare], np.int64)]
        have = at[at >= 0]
        path = np.r_[0, classes, 0]
        # the end is the only word of its class: its probability there is 1
        score = m.transitions[path[:-1], path[1:]].sum() + self.word[have].sum() - m.sizes[classes].sum()
        base, known = self.base[have].sum() - self.least * (len(found) + 1), len(have)
        if END in self.at:
            known, base = known + 1, base + self.base[self.at[END]]
        times = Counter(found[i] for i in rare)
        open_ = [{"word": w, "n": n, "unknown": float(m.unknown[m.classes[m.units[w]]])} for w, n in times.items()]
        return len(found) + 1, known, float(base), float(score), open_


def scores(docs: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key with held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), held_out(key).alias("__held"), texts(docs, text).alias("__text"))
    train = rows.where(~F.col("__held"))
    counts = materialize(word_counts(train), "brown-words")
    model = learn(train, counts, config)
    shared = spark.sparkContext.broadcast(model)

    def step(scorer: Scorer, keys, held, data) -> Iterator[tuple]:
        first = TaskContext.get().partitionId() << 40
        for k, h, t in zip(keys, held, data, strict=True):
            scorer.row = getattr(scorer, "row", -1) + 1
            yield first + scorer.row, k, h, *scorer.text(t)

    schema = f"row long, `{key}` {kind}, held_out boolean, n_tokens long, n_known long, base double, sure double, open array<struct<word:binary,n:bigint,unknown:double>>"
    scored = materialize(map_rows(rows, [key, "__held", "__text"], schema, step, lambda: Scorer(shared.value)), "brown-scored")
    n = F.col("n")
    there = n.isNotNull()
    asked = scored.select("row", F.explode("open").alias("o")).select("row", "o.word", F.col("o.n").alias("times"), "o.unknown")
    met = asked.join(counts.where(n < max(1, int(np.ceil(model.tokens * config.known_share)))), "word", "left").groupBy("row").agg(
        F.sum(F.when(there, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce(n, F.lit(0)) + 1)).alias("base_more"),
        F.sum(F.col("times") * F.when(there, F.log10(n - model.word_discount)).otherwise(F.col("unknown"))).alias("sure_more"),
    )
    whole = scored.drop("open").join(met, "row", "left")
    score = F.col("sure") + F.coalesce("sure_more", F.lit(0.0))
    return whole.select(
        key, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
