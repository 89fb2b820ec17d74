"""Content-addressed store of token ids.

Every document's id stream is cut into chunks where a rolling hash of the last ids meets a mask, so that
an edit moves only the cuts beside it. A chunk is kept once under the hash of its content; a document's recipe
lists its chunks; recipes lie in ascending order of their ids, each range with a manifest: the root of a
Merkle tree over its recipes, the ids before it, and their number.

Layout under the store's path (all Parquet, in whatever store Spark writes to):

- ``objects/kind=chunk``: key (hash), n (ids), data (ids as little-endian 16 or 32 bits)
- ``objects/kind=recipe``: doc_id, n (ids), data (keys of the chunks in order)
- ``recipes``: the recipes in order with their range, their place in it and the ids before them in it
- ``manifest``: a row a range: first id, recipes, ids before, ids, Merkle root

Defined cases: a null text is an empty one; an empty text has its end id alone; repeated ids are ordered by
their content's hash and each kept; rows with a null id come first; an empty table gives empty tables and no
manifest. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_rows, shared_path, slices
from .tokens import SLICE_CHARS, encoder, vocabulary

KEY_BYTES = 16


@dataclass(frozen=True)
class Config:
    vocabulary: str | None = None
    end_id: int = 1
    #: Chunks have 2 ** mask_bits ids on average, and these at least and at most.
    mask_bits: int = 8
    least: int = 64
    most: int = 1024
    #: Recipes of a range, about, at most.
    range: int = 100_000


# chunking --------------------------------------------------------------------------------------


def gear(ids: np.ndarray) -> np.ndarray:
    """A rolling hash of the last 16 ids at every place: the sum of their mixed values, each shifted by its distance."""
    h = (ids.astype(np.uint32) + np.uint32(0x9E37)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    for step in (1, 2, 4, 8):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def cuts(ids: np.ndarray, config: Config = Config()) -> list[int]:
    """Ends of the chunks of one stream."""
    n = len(ids)
    if n <= config.least:
        return [n]
    marks = np.flatnonzero((gear(ids) >> np.uint32(32 - config.mask_bits)) == 0) + 1
    out, start = [], 0
    for mark in marks.tolist():
        while mark - start > config.most:
            start += config.most
            out.append(start)
        if mark - start >= config.least and mark < n:
            out.append(mark)
            start = mark
    while n - start > config.most:
        start += config.most
        out.append(start)
    out.append(n)
    return out


def content_key(data: bytes) -> bytes:
    return blake2b(data, digest_size=KEY_BYTES).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over the leaves in order; an odd one at the end moves up as it is."""
    level = [blake2b(b"\0" + leaf, digest_size=32).digest() for leaf in leaves]
    while len(level) > 1:
        level = [blake2b(b"\1" + level[i] + level[i + 1], digest_size=32).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else blake2b(b"", digest_size=32).digest()


# crc32 of joined streams -----------------------------------------------------------------------


def _zeros_tables(bits: int) -> list[np.ndarray]:
    """For every k, four tables of 256 that carry a crc32 over 2 ** k zero bytes."""
    columns = np.array([zlib.crc32(b"\0", 1 << i ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for i in range(32)], np.uint32)

    def apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where(v >> np.uint32(i) & np.uint32(1), m[i], np.uint32(0))
        return out

    out, byte = [], np.arange(256, dtype=np.uint32)
    for _ in range(bits):
        out.append(np.stack([apply(columns, byte << np.uint32(8 * b)) for b in range(4)]))
        columns = apply(columns, columns)
    return out


_ZEROS: list[np.ndarray] = []


def joined_crc32(crcs: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """crc32 of each run of parts from the parts' own crc32 and sizes in bytes; ``starts``: first part of each run."""
    if not _ZEROS:
        _ZEROS.extend(_zeros_tables(44))
    ends = np.append(starts[1:], len(crcs))
    total = np.cumsum(sizes)
    after = np.repeat(total[ends - 1], ends - starts) - total
    value = crcs.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        at = np.flatnonzero(after >> k & 1)
        v, z = value[at], _ZEROS[k]
        value[at] = z[0][v & 255] ^ z[1][v >> 8 & 255] ^ z[2][v >> 16 & 255] ^ z[3][v >> 24]
    return np.bitwise_xor.reduceat(value, starts) if len(starts) else value


# writing ---------------------------------------------------------------------------------------

_OBJECT = "kind string, key binary, doc_id {kind}, n long, data binary"


def write(docs: DataFrame, path: str, config: Config = Config(), key: str = "doc_id", text: str = "text") -> None:
    """Encodes and stores the documents under ``path``: one pass over the texts, one exchange of the chunks."""
    spark = docs.sparkSession
    file = config.vocabulary or vocabulary()
    kind = docs.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(_OBJECT.format(kind=kind))

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, form = encoder(file), arrow_schema(schema)
        end = np.array([config.end_id], codes.type)
        task, row, seen = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts, SLICE_CHARS):
                out: list[tuple] = []
                for doc, ids in zip(ids_of[lo:hi], codes.encode(texts[lo:hi]), strict=True):
                    ids = np.concatenate([ids, end])
                    data, width, start, refs = ids.tobytes(), ids.itemsize, 0, []
                    for stop in cuts(ids, config):
                        part = data[start * width : stop * width]
                        name = content_key(part)
                        refs.append(name)
                        if name not in seen:
                            seen.add(name)
                            out.append(("chunk", name, None, stop - start, part))
                        start = stop
                    row += 1
                    out.append(("recipe", struct.pack(">IQ", task, row), doc, len(ids), b"".join(refs)))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)

    found = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(objects, schema)
    # recipes have keys of their own, so that chunks and recipes share the exchange and nothing is encoded twice
    found.dropDuplicates(["kind", "key"]).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")

    recipe = T.StructType.fromDDL(f"doc_id {kind}, n long, data binary")
    recipes = spark.read.schema(recipe).parquet(f"{path}/objects/kind=recipe") if exists(spark, f"{path}/objects/kind=recipe") else spark.createDataFrame([], recipe)
    placed = T.StructType.fromDDL(f"part int, place long, doc_id {kind}, before long, n long, data binary")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, before, form = TaskContext.get().partitionId(), 0, 0, arrow_schema(placed)
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(n) + before
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(at, at + len(n))), batch.column(0), pa.array(sums - n), batch.column(1), batch.column(2)], schema=form)
            at, before = at + len(n), int(sums[-1]) if len(n) else before

    order = [F.col("doc_id").asc_nulls_first(), F.col("data").asc()]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-recipes.count() // config.range))
    recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(place, placed).write.option("compression", "zstd").parquet(f"{path}/recipes")

    # a row a range
    rows = spark.read.schema(placed).parquet(f"{path}/recipes")
    before, manifest = 0, []
    for seal in sorted(seals(rows).collect()):
        manifest.append((*seal[:4], before, seal[4]))
        before += seal[3]
    spark.createDataFrame(manifest, "part int, first string, recipes long, ids long, before long, root binary").coalesce(1).write.parquet(f"{path}/manifest")


_SEAL = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("recipes", T.LongType()), T.StructField("ids", T.LongType()), T.StructField("root", T.BinaryType())])


class Merkle:
    """The root of ``merkle`` over leaves that come one by one, from the roots of whole subtrees, the largest first."""

    def __init__(self):
        self.roots: list[tuple[int, bytes]] = []  # (height, root)

    def add(self, one: bytes) -> None:
        height, root = 0, blake2b(b"\0" + one, digest_size=32).digest()
        while self.roots and self.roots[-1][0] == height:
            root = blake2b(b"\1" + self.roots.pop()[1] + root, digest_size=32).digest()
            height += 1
        self.roots.append((height, root))

    def root(self) -> bytes:
        if not self.roots:
            return merkle([])
        out = self.roots[-1][1]
        for _, left in reversed(self.roots[:-1]):
            out = blake2b(b"\1" + left + out, digest_size=32).digest()
        return out


def _seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a range: its first id, recipes, ids and Merkle root. Rows come sorted by range; none is held."""
    form, out, own = arrow_schema(_SEAL), [], None

    def end() -> tuple:
        return own[0], own[1], own[2], own[3], own[4].root()

    for batch in batches:
        for p, _place, doc, _before, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own is None or own[0] != p:
                if own:
                    out.append(end())
                own = [p, str(doc), 0, 0, Merkle()]
            own[2] += 1
            own[3] += n
            own[4].add(leaf(doc, n, data))
    if own:
        out.append(end())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)


def seals(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "place").mapInArrow(_seal, _SEAL)


def leaf(doc, n: int, data: bytes) -> bytes:
    return blake2b(f"{doc}|{n}|".encode() + data, digest_size=32).digest()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


# reading ---------------------------------------------------------------------------------------


def id_width(config: Config) -> int:
    return encoder(config.vocabulary or vocabulary()).type.itemsize


def chunks(spark: SparkSession, path: str) -> DataFrame:
    form = T.StructType.fromDDL("key binary, n long, data binary")
    where = f"{path}/objects/kind=chunk"
    return spark.read.schema(form).parquet(where) if exists(spark, where) else spark.createDataFrame([], form)


def placed_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes in order with ``start``: all ids before them. The manifest is a row a range."""
    rows = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest").select("part", F.col("before").alias("base"))
    return rows.join(F.broadcast(manifest), "part").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")


def read_digests(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored files.

    Every chunk's bytes are read once, held against their key and summed up as (ids, crc32); a document's
    crc32 follows from those of its chunks in order, so that no chunk's bytes move.
    """
    width = id_width(config)

    def summed(keys, counts, datas) -> Iterator[tuple]:
        for name, n, data in zip(keys, counts, datas, strict=True):
            if content_key(data) != name or len(data) != n * width:
                raise ValueError(f"chunk {name.hex()} is damaged")
            yield name, n, zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())

    sums = map_rows(chunks(spark, path), ["key", "n", "data"], "key binary, n long, crc long", summed)
    recipes = placed_recipes(spark, path)
    kind = recipes.schema["doc_id"].dataType.simpleString()
    refs = recipes.select("part", "place", F.expr(f"posexplode(transform(sequence(0, length(data) div {KEY_BYTES} - 1), i -> substring(data, i * {KEY_BYTES} + 1, {KEY_BYTES}))) as (seq, key)"))
    # a chunk that many documents share is a hot key here; the runtime splits such partitions
    parts = refs.join(sums, "key", "left").groupBy("part", "place").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "crc"))).alias("parts"))
    whole = recipes.select("part", "place", "doc_id", "start", F.col("n").alias("stated"), F.floor(F.length("data") / KEY_BYTES).alias("refs")).join(parts, ["part", "place"])
    whole = whole.withColumn("sizes", F.transform("parts", lambda x: F.coalesce(x["n"], F.lit(-1)))).withColumn("crcs", F.transform("parts", lambda x: x["crc"])).drop("parts")

    def join(docs, starts, stated, refs, sizes, crcs) -> Iterator[tuple]:
        if any(len(p) != r for p, r in zip(sizes, refs, strict=True)):
            raise ValueError("a chunk is missing")
        sizes = np.array([n for found in sizes for n in found], np.int64)
        if sizes.min(initial=0) < 0:
            raise ValueError("a chunk is missing")
        crcs = np.array([c for found in crcs for c in found], np.uint32)
        first = np.cumsum([0, *refs[:-1]])
        totals, crc = np.add.reduceat(sizes, first), joined_crc32(crcs, 4 * sizes, first)
        if totals.tolist() != list(stated):
            raise ValueError("a recipe's chunks don't have its number of ids")
        return zip(docs, starts, totals.tolist(), crc.tolist(), strict=True)

    return map_rows(whole, ["doc_id", "start", "stated", "refs", "sizes", "crcs"], f"doc_id {kind}, start long, n_tokens long, ids_crc32 long", join)


def reconstruct(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """(doc_id, start, ids): every document's ids, put together from its recipe and the chunks."""
    width = id_width(config)
    recipes = placed_recipes(spark, path)
    kind = recipes.schema["doc_id"].dataType.simpleString()
    refs = recipes.select("part", "place", F.expr(f"posexplode(transform(sequence(0, length(data) div {KEY_BYTES} - 1), i -> substring(data, i * {KEY_BYTES} + 1, {KEY_BYTES}))) as (seq, key)"))
    whole = chunks(spark, path).select("key", "n", F.col("data").alias("bytes"))
    parts = refs.join(whole, "key", "left").groupBy("part", "place").agg(F.sort_array(F.collect_list(F.struct("seq", "key", "n", "bytes"))).alias("parts"))

    def join(docs, starts, stated, parts) -> Iterator[tuple]:
        for doc, start, n, found in zip(docs, starts, stated, parts, strict=True):
            if any(x["bytes"] is None or content_key(x["bytes"]) != x["key"] or len(x["bytes"]) != x["n"] * width for x in found):
                raise ValueError(f"a chunk of document {doc} is missing or damaged")
            ids = np.frombuffer(b"".join(x["bytes"] for x in found), f"<u{width}").astype(np.int64).tolist()
            if len(ids) != n:
                raise ValueError(f"the chunks of document {doc} don't have its number of ids")
            yield doc, start, ids

    return map_rows(recipes.select("part", "place", "doc_id", "start", F.col("n").alias("stated")).join(parts, ["part", "place"]), ["doc_id", "start", "stated", "parts"], f"doc_id {kind}, start long, ids array<int>", join)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(part, good): whether each range's recipes still have the manifest's Merkle root."""
    now = seals(spark.read.parquet(f"{path}/recipes")).select("part", F.col("root").alias("found"))
    return spark.read.parquet(f"{path}/manifest").join(now, "part", "left").select("part", F.coalesce(F.col("root") == F.col("found"), F.lit(False)).alias("good"))


def check(spark: SparkSession, path: str) -> None:
    bad = [r.part for r in verify(spark, path).where("not good").limit(10).collect()]
    if bad:
        raise ValueError(f"recipes of the ranges {bad} differ from the manifest")


def stored(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Writes the documents to a store in the shared folder, holds it against its manifest and reads the digests back."""
    path = shared_path(docs.sparkSession, "store")
    write(docs, path, config)
    check(docs.sparkSession, path)
    return read_digests(docs.sparkSession, path, config)
