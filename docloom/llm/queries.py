"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, castore, counts, decontam, html, lines, matroska, mixing, periods, pii, probmin, quality, whitening
from .common import label_bucket, table


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document stay, and the places of those that go."""
    found = lines.removed_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size("removed")).alias("n_kept"), "removed")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; labels of held-out rows are never seen."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.where(label_bucket("doc_id") != 0))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", (label_bucket("doc_id") == 0).alias("held_out"), "score", "predicted")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with format-preserving pseudonyms for its personal data."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a Matroska file, read back: sizes, hashes and features."""
    return matroska.digest(matroska.media_column(table(spark, sf_dir, "documents")))


def op6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a few edits."""
    return counts.count_edits(table(spark, sf_dir, "documents"), counts.sample_edits)


def op7_castore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in the content-addressed store, read back from its files."""
    return castore.stored(table(spark, sf_dir, "documents"))


def op8_probmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates."""
    return probmin.classes(table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH grams AS (
  SELECT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram
  FROM (
    SELECT kind, id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)
  )
), sets AS (SELECT DISTINCT kind, id, gram FROM grams),
sizes AS (SELECT id AS item_id, CAST(count(*) AS INTEGER) AS shingles FROM sets WHERE kind = 'b' GROUP BY id),
pairs AS (
  SELECT d.id AS doc_id, b.id AS item_id, CAST(count(*) AS INTEGER) AS shared
  FROM sets b JOIN sets d ON d.gram = b.gram AND d.kind = 'd' WHERE b.kind = 'b' GROUP BY 1, 2
)
SELECT doc_id, item_id, shared, shingles, shared / shingles AS containment
FROM pairs JOIN sizes USING (item_id) WHERE shared >= 0.8 * shingles
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def echoed(key: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract's tenth of documents: from a place on, which the id's crc32 gives, they repeat with a period. A null id counts as an empty one."""
    h, n = zlib.crc32(b"" if key is None else str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words."""
    return periods.digest(periods.periodic_runs(table(spark, sf_dir, "documents"), rewrite=echoed))


def op12_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability under the class bigram model, and under smoothed word counts."""
    return brown.scores(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite vector on the 16 whitened principal components."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def queries() -> dict:
    ops = (op1_lines, op2_quality, op3_html, op4_pii, op5_matroska, op6_counts, op7_castore, op8_probmin, op9_decontam, op10_mixing, op11_periods, op12_brown, op13_whitening)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontam": OP9_SQL}
