"""Chunking: paragraphs and section trees by windows over lines; greedy packing by a fold over each document's pieces."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Documents whose texts a fold holds at once.
SLICE = 64
HEADING = r"^(#{1,3})\s+(.+)"


@dataclass(frozen=True)
class Sizes:
    """In characters; texts that are mostly English have twice these."""

    small_min: int = 500
    small_max: int = 800
    parent_min: int = 1500
    parent_max: int = 3500


def size_scale(size: Column, unit: int = 1 << 20) -> Column:
    """Larger files have larger chunks: from 2, 5, 10 and 20 units on."""
    return F.when(size >= 20 * unit, 4.0).when(size >= 10 * unit, 3.0).when(size >= 5 * unit, 2.0).when(size >= 2 * unit, 1.5).otherwise(1.0)


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return lines.select("doc", "pos", F.length("raw").alias("size"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc, nth, text): runs of lines between blank ones; a line that begins with # is a paragraph of its own."""
    head, blank = F.col("line").startswith("#"), F.col("line") == ""
    run = F.sum((head | blank).cast("int")).over(Window.partitionBy("doc").orderBy("pos"))
    runs = _lines(docs).withColumn("run", run).withColumn("head", head).where(~blank)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    found = runs.groupBy("doc", "run", "head").agg(F.min("pos").alias("pos"), text.alias("text"))
    return found.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("pos")).alias("nth"), "text")


def section_tree(docs: DataFrame) -> DataFrame:
    """(doc, nth, level, section, text, heading, start_char, end_char): headings (level 1) and paragraphs (level 2) in order.

    A heading of any level opens a section; a paragraph's heading is the last one before it.
    """
    doc = Window.partitionBy("doc").orderBy("pos")
    chars = F.sum(F.col("size") + 1).over(doc)
    lines = _lines(docs).withColumn("end", chars).withColumn("start", F.col("end") - F.col("size") - 1)
    lines = lines.withColumn("is_head", F.col("line").rlike(HEADING)).withColumn("title", F.when(F.col("is_head"), F.regexp_replace(F.regexp_extract("line", HEADING, 2), r"^\s+|\s+$", "")))
    marked = lines.select(
        "*",
        F.last("title", ignorenulls=True).over(doc).alias("heading"),
        F.sum(F.col("is_head").cast("int")).over(doc).alias("section"),
        F.sum((F.col("is_head") | (F.col("line") == "")).cast("int")).over(doc).alias("run"),
    )
    heads = marked.where("is_head").select("doc", "pos", F.lit(1).alias("level"), "section", F.col("title").alias("text"), F.col("title").alias("heading"), "start", "end")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    bodies = marked.where("not is_head and line <> ''").groupBy("doc", "section", "run").agg(F.min("pos").alias("pos"), text.alias("text"), F.coalesce(F.first("heading"), F.lit("")).alias("heading"), F.min("start").alias("start"), F.max("end").alias("end"))
    nodes = heads.unionByName(bodies.select("doc", "pos", F.lit(2).alias("level"), "section", "text", "heading", "start", "end"))
    return nodes.select("doc", F.row_number().over(doc).alias("nth"), "level", "section", "text", "heading", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


# folds -----------------------------------------------------------------------------------------


_LETTERS = (string.ascii_lowercase + string.ascii_uppercase).encode()
#: What white space and the end of a line are to the patterns above.
_SPACE, _ENDS = " \t\n\x0b\f\r", "\x85\u2028\u2029"
_HEAD = re.compile(rf"#{{1,3}}[{_SPACE}]+([^\n\r{_ENDS}]+)")


def _stripped(line: str) -> str:
    line = line.strip(_SPACE)
    return line[:-1].rstrip(_SPACE) + line[-1] if line and line[-1] in _ENDS else line


def section_nodes(text: str) -> list[tuple[int, int, str, str]]:
    """(level, section, text, heading) of one text: what ``section_tree`` gives for it, in order."""
    out: list[tuple[int, int, str, str]] = []
    held: list[str] = []
    section, title = 0, ""
    for line in [*map(_stripped, text.split("\n")), ""]:
        head = _HEAD.match(line) if line.startswith("#") else None
        if line and not head:
            held.append(line)
            continue
        if held:
            out.append((2, section, "\n".join(held), title))
            held.clear()
        if head:
            section, title = section + 1, _stripped(head[1])
            out.append((1, section, title, title))
    return out


def paragraph_texts(text: str) -> list[str]:
    """The texts of ``paragraphs`` of one text, in order."""
    out: list[str] = []
    held: list[str] = []
    for line in [*map(_stripped, text.split("\n")), ""]:
        if line and line[0] != "#":
            held.append(line)
            continue
        if held:
            out.append("\n".join(held))
            held.clear()
        if line:
            out.append(line)
    return out


def mostly_english(text: str) -> bool:
    if not text.strip():
        return False
    raw = text.encode("utf-8", "surrogatepass")
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    if letters > 0.40 * len(text):
        return True
    return letters > 0.25 * len(text) and len(re.findall("[a-zA-Z]+", text)) > 2 * len(re.findall("[一-鿿]", text))


def sentences(text: str) -> list[str]:
    """Sentences; pieces of under ten characters join the one before."""
    english = len(text) > 50 and mostly_english(text)
    ends = r"(?<=[.!?])\s+" if english else r"(?<=[。！？])\s*"
    out: list[str] = []
    for piece in filter(None, map(str.strip, re.split(ends, text))):
        if out and len(piece) < 10:
            out[-1] += (" " if english else "") + piece
        else:
            out.append(piece)
    return out or [text]


def pack(pieces: list[str], most: int, glue: str, carry: int = 0) -> list[str]:
    """Pieces joined up to ``most`` characters; ``carry`` last characters of a full one begin the next."""
    out, held = [], ""
    for piece in pieces:
        if held and len(held) + len(piece) > most:
            out.append(held.strip())
            held = held[-carry:] + piece if 0 < carry < len(held) else piece
        else:
            held = held + glue + piece if held else piece
    return out + [held.strip()] if held.strip() else out


def long_pieces(text: str, most: int, overlap: int) -> list[str]:
    """A long paragraph in packed sentences; in English very short pieces are taken as parts of abbreviations."""
    english = mostly_english(text)
    parts: list[str] = []
    for piece in filter(None, map(str.strip, re.split(r"(?<=[。！？\n.!?])\s*", text))):
        if english and parts and len(piece) < 10 and not re.search("[，、；：,;:]", piece):
            parts[-1] += " " + piece
        else:
            parts.append(piece)
    return pack(parts, most, " " if english and len(text) > 50 else "", overlap) or [text]


def smalls(nodes: list[tuple], sizes: Sizes) -> Iterator[list]:
    """[text, heading, section] of small chunks from (level, section, text, heading)."""
    out: list[list] = []
    held: list[str] = []
    heading, section = "", 0

    def flush() -> None:
        if held:
            out.append(["\n\n".join(held).strip(), heading, section])
            held.clear()

    for level, at, text, title in nodes:
        if level == 1:
            section = at
            continue
        width = len("\n\n".join(held))
        if len(text) <= sizes.small_max:
            if held and width + len(text) + 1 > sizes.small_max:
                flush()
            if not held:
                heading = title
            held.append(text)
            if len("\n\n".join(held)) >= sizes.small_min:
                flush()
            continue
        flush()
        heading = title
        for piece in pack(sentences(text), sizes.small_max, " "):
            if len(piece) >= sizes.small_min or not out:
                out.append([piece, title, section])
            else:
                out[-1][0] += "\n\n" + piece
    flush()
    return iter(out)


def parents(nodes: list[tuple], sizes: Sizes) -> Iterator[tuple]:
    """(text, heading, section, segment) of parent chunks: a section's paragraphs, in segments of bounded size."""
    groups: list[tuple[str, int, list[str]]] = [("", 0, [])]
    for level, section, text, _ in nodes:
        if level == 1:
            groups.append((text, section, []))
        else:
            groups[-1][2].append(text)
    for heading, section, texts in groups:
        segment = 1
        for piece in pack(texts, sizes.parent_max, "\n\n"):
            if len(piece) >= sizes.parent_min:
                yield piece, heading, section, segment
                segment += 1


def _scaled(text: str, sizes: Sizes) -> Sizes:
    return Sizes(*(2 * n for n in (sizes.small_min, sizes.small_max, sizes.parent_min, sizes.parent_max))) if mostly_english(text) else sizes


def _by_document(docs: DataFrame, schema: str, step: Callable[[str, str], list[tuple]]) -> DataFrame:
    """One fold a document, where it lies: its whole text is in its row, so nothing is shuffled and no more than ``SLICE`` documents are held."""
    kind = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                rows = [r for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if text is not None for r in step(doc, text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select("doc", "text").mapInArrow(run, kind)


def _small_rows(doc: str, nodes: list[tuple], own: Sizes) -> list[tuple]:
    return [(doc, f"{doc}_small_{i}", f"{doc}_parent_{section}", i, heading, text[:80], text) for i, (text, heading, section) in enumerate(smalls(nodes, own), 1)]


def _parent_rows(doc: str, nodes: list[tuple], own: Sizes) -> list[tuple]:
    return [(doc, f"{doc}_parent_{section}" + (f"_{n}" if n > 1 else ""), i, heading, text) for i, (text, heading, section, n) in enumerate(parents(nodes, own), 1)]


def _nodes(text: str, sizes: Sizes) -> tuple[list[tuple], Sizes]:
    nodes = section_nodes(text)
    return nodes, _scaled("\n".join(n[2] for n in nodes), sizes)


_SMALL = "doc string, chunk_id string, parent_id string, chunk_index int, heading string, summary string, text string"


def small_chunks(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(doc, chunk_id, parent_id, chunk_index, heading, summary, text) of the small chunks of each document, all of them."""
    return _by_document(docs, _SMALL, lambda doc, text: _small_rows(doc, *_nodes(text, sizes)))


def parent_chunks(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(doc, chunk_id, chunk_index, heading, text) of parent chunks; later segments of a section have a suffix."""
    return _by_document(docs, "doc string, chunk_id string, chunk_index int, heading string, text string", lambda doc, text: _parent_rows(doc, *_nodes(text, sizes)))


def linked_chunks(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``linked`` small and parent chunks, of documents whose names are distinct: both come from one fold, so they meet without a join."""

    def step(doc: str, text: str) -> list[tuple]:
        nodes, own = _nodes(text, sizes)
        held = {chunk: (text, text[:100], heading) for _, chunk, _, heading, text in _parent_rows(doc, nodes, own)}
        return [(*row, *held.get(row[2], (None, None, None))) for row in _small_rows(doc, nodes, own)]

    return _by_document(docs, f"{_SMALL}, parent_content string, parent_summary string, section_title string", step)


def split_documents(docs: DataFrame, least: int = 500, most: int = 800, overlap: int = 50) -> DataFrame:
    """(doc, chunk_id, chunk_index, summary, text): paragraphs packed greedily; one that is too small goes on past the limit."""

    def step(doc: str, whole: str) -> list[tuple]:
        texts = paragraph_texts(whole)
        scale = 2 if mostly_english("\n".join(texts)) else 1
        low, high = least * scale, most * scale
        out, held = [], ""
        for text in texts:
            if len(text) > high:
                out += [held] if held else []
                held = ""
                out += long_pieces(text, high, overlap)
            elif held and len(held) + len(text) + 1 > high and len(held) >= low:
                out.append(held)
                held = text
            else:
                held = f"{held}\n\n{text}" if held else text
        out += [held] if held else []
        return [(doc, f"{doc}_chunk_{i}", i, text[:50] + ("..." if len(text) > 50 else ""), text) for i, text in enumerate(out, 1)]

    return _by_document(docs, "doc string, chunk_id string, chunk_index int, summary string, text string", step)


def _texts(docs: DataFrame, split: Callable[[str], list[str]]) -> DataFrame:
    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t or ""))

    return docs.select("doc", F.posexplode(pieces("text")).alias("nth", "text"))


def split_long(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    return _texts(docs, lambda t: long_pieces(t, most, overlap))


def sentence_table(docs: DataFrame) -> DataFrame:
    return _texts(docs, sentences)


def linked(small: DataFrame, parent: DataFrame) -> DataFrame:
    """Small chunks with their parent's text, its beginning and its section's title."""
    own = parent.select(F.col(parent.columns[0]).alias("parent_id"), F.col("text").alias("parent_content"), F.col("heading").alias("section_title"))
    return small.join(own, "parent_id", "left").select(*small.columns, "parent_content", F.substring("parent_content", 1, 100).alias("parent_summary"), "section_title")


def capped(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first rows of each document: a report limit of the feature itself."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("n") <= most).drop("n")
