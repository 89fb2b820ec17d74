"""The one path from raw documents to chunks: sanitise, Markdown, cleanup, gate, chunk, embed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as X
from ..functions.embedding import PASSAGE_PREFIX, embed
from . import chunking


def metadata(docs: DataFrame) -> DataFrame:
    t = F.col("full_text")
    return docs.withColumn("metadata", F.struct(X.title(t).alias("title"), X.abstract(t).alias("abstract"), X.doi(t).alias("doi"), X.sections(t).alias("sections"), X.is_mostly_english(t).alias("is_english")))


def markdown(docs: DataFrame) -> DataFrame:
    """(doc, text) from (doc, pages): each page as Markdown, joined by blank lines; a document that comes out empty keeps its raw text."""
    rows = docs.select("doc", F.posexplode("pages").alias("n", "page")).select("doc", "n", P.page_markdown(X.sanitized(F.col("page.text")), F.col("page.page")).alias("md"), F.col("page.text").alias("raw"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]), "\n\n")
    joined = rows.groupBy("doc").agg(ordered("md").alias("md"), ordered("raw").alias("raw"))
    return joined.select("doc", F.when(F.trim("md") == "", F.col("raw")).otherwise(F.col("md")).alias("text"))


def process(docs: DataFrame, sizes: chunking.Sizes = chunking.Sizes(), model=None) -> DataFrame:
    """Small chunks of (doc, text) that pass the gate, linked to their parents, with embeddings if there is a model."""
    gated = X.cleanup(docs.select("doc", "text")).where("cleanup.passed").select("doc", F.col("cleanup.text").alias("text"))
    out = chunking.linked_chunks(gated, sizes)
    return out if model is None else out.withColumn("embedding", embed(F.col("text"), model, PASSAGE_PREFIX))
