"""Which texts contain which of many sentences: one Aho-Corasick automaton a block of sentences, one pass over the texts a block.

Sentences are a stated query set of any number: blocks of bounded size are brought to the driver one after the other and sent to all tasks; what a
task emits is a row for each sentence and text that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import materialize

#: Characters and sentences of a block; an automaton takes some 50 bytes a character.
BLOCK_CHARS, BLOCK_SENTENCES = 2_000_000, 50_000
#: What doesn't count: white space of ASCII.
BLANK = b" \t\n\x0b\x0c\r"


def solid(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(None, BLANK).decode("utf-8", "surrogatepass")


def blocks(patterns: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """(keys, patterns) of bounded size."""
    keys, texts, size = [], [], 0
    for key, text in patterns.toLocalIterator():
        keys.append(key)
        texts.append(text)
        size += len(text)
        if size >= BLOCK_CHARS or len(keys) >= BLOCK_SENTENCES:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def found_in(docs: DataFrame, keys: list, texts: list[str], schema: T.StructType) -> DataFrame:
    """(item_id, doc_id, place) of each pattern (numbered by place) in each of the ``docs`` (doc_id, text), once a pair."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, (names, patterns) = to_arrow_schema(schema), shared.value
        search, same, always = ahocorasick.Automaton(), {}, []
        for i, p in enumerate(patterns):
            if p:
                same.setdefault(p, []).append(i)
            else:
                always.append(i)
        for p, places in same.items():
            search.add_word(p, places)
        search.make_automaton()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None:
                    hits = {id(places): places for _, places in search.iter(solid(text))} if same else {}
                    rows += [(names[i], doc, i) for places in (*hits.values(), always) for i in places]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return docs.mapInArrow(run, schema)


def contained(sentences: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents (doc_id, text) that contain a sentence (item_id, sentence), white space aside.

    A null sentence or text matches nothing, an empty sentence every text; repeated rows match each.
    """
    schema = T.StructType([T.StructField("item_id", sentences.schema["item_id"].dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("place", T.IntegerType())])
    out = None
    for keys, texts in blocks(sentences.where("sentence is not null").select("item_id", "sentence")):
        hits = found_in(docs.select("doc_id", "text"), keys, [solid(t) for t in texts], schema)
        out = hits if out is None else out.unionByName(hits)
    return (out if out is not None else docs.sparkSession.createDataFrame([], schema)).select("item_id", "doc_id")


def gold_lookup(sentences: DataFrame, docs: DataFrame, head: int = 30, least: int = 8) -> DataFrame:
    """(item_id, doc_id, how): documents that contain a sentence, white space aside; for sentences that none contains those with its first ``head`` characters.

    Both are patterns of one automaton, so texts are read once a block; the hits are written before sentences with an exact hit are taken from the others.
    """
    whole = F.regexp_replace("sentence", "[ \t\n\\x0B\f\r]+", "")
    first = F.substring(whole, 1, head)
    both = sentences.select(F.struct("item_id", F.lit("exact").alias("how")).alias("item_id"), whole.alias("sentence")).unionByName(
        sentences.where(F.length(first) >= least).select(F.struct("item_id", F.lit("prefix").alias("how")).alias("item_id"), first.alias("sentence"))
    )
    hits = materialize(contained(both, docs).select("item_id.item_id", "doc_id", "item_id.how"), "gold")
    exact = hits.where("how = 'exact'")
    return exact.unionByName(hits.where("how = 'prefix'").join(exact.select("item_id").distinct(), "item_id", "left_anti").select(*exact.columns))
