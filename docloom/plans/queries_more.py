"""Queries of page conversion, ingestion, embeddings, ablations and the projections of logs and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions.embedding import embed
from ..operators import evaluation as E, fusion, ingest, retrieval
from . import queries_eval as Q
from .queries_search import _HYBRID
from .queries_text import _pages
from .registry import query
from .tables import chunks, documents, literal, literal_sql, table, with_chunks

_GOLD = Q._GOLD


@query("p8_reflow")
def reflow(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", P.reflow(F.col("text")).alias("text"))


@query("p9_tables")
def tables(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", P.tables(F.col("text")).alias("text"))


@query("p11_headings")
def headings(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", P.headings(F.col("text")).alias("text"))


@query("p12_markdown")
def markdown(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc"), F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text")), F.struct(F.lit(2).alias("page"), F.lit("").alias("text"))).alias("pages"))
    return ingest.markdown(docs)


@query("k10_process")
def process(spark, sf_dir):
    return ingest.process(documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc"), "text"))


@query("s17_embeddings")
def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", embed(F.col("text"), prefix="query: ").alias("embedding"))


_METRIC = "round(CAST(avg(CAST(first IS NOT NULL AS INT)) AS DOUBLE), 4) AS hit_rate, round(CAST(avg(coalesce(1.0 / first, 0)) AS DOUBLE), 4) AS mrr"


@query("e12_ablation", f"{_HYBRID}, {_GOLD}, allv AS (SELECT 'vector' AS variant, query_id, id, rank FROM v UNION ALL SELECT 'bm25', query_id, id, rank FROM l UNION ALL SELECT 'hybrid', query_id, id, rank FROM fused), n AS (SELECT variant, query_id, filename, rank FROM allv JOIN chunks ON chunk_id = id WHERE rank <= 10), firsts AS (SELECT t.variant, g.query_id, min(n.rank) AS first FROM (SELECT DISTINCT query_id, filename FROM gold) g CROSS JOIN (SELECT DISTINCT variant FROM allv) t LEFT JOIN n ON n.variant = t.variant AND n.query_id = g.query_id AND n.filename = g.filename GROUP BY 1, 2) SELECT variant, {_METRIC} FROM firsts GROUP BY variant")
def ablation(spark, sf_dir):
    """The same questions through vector, lexical and fused lists."""
    from ..operators import bm25, vectors as V
    from .tables import lexical, questions, stand_ins

    vec = V.nearest(*stand_ins(spark, sf_dir), 20).withColumnRenamed("vec_id", "id")
    lex = bm25.search(lexical(spark, sf_dir), questions(spark, sf_dir), 20).withColumnRenamed("chunk_id", "id")
    named = lambda df, name: df.select(F.lit(name).alias("variant"), "query_id", "id", "rank")
    lists = named(vec, "vector").unionByName(named(lex, "bm25")).unionByName(named(fusion.rrf(vec, lex), "hybrid")).where(F.col("rank") <= 10)
    files = with_chunks(lists, chunks(spark, sf_dir).select("chunk_id", "filename"))
    gold = Q._gold(spark, sf_dir).distinct()
    grid = gold.join(F.broadcast(literal(spark, "variant", "('vector'), ('bm25'), ('hybrid')")))
    first = grid.join(files, ["variant", "query_id", "filename"], "left").groupBy("variant", "query_id").agg(F.min("rank").alias("first"))
    return first.groupBy("variant").agg(F.round(E.share(F.col("first").isNotNull()), 4).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


@query("e13_hit_at_k", f"{Q._HITS} SELECT query_id, bool_or(h.rank <= 5) AS hit, min(h.rank) AS gold_rank FROM gold g JOIN hits h USING (query_id, filename) GROUP BY query_id")
def hit_at_k(spark, sf_dir):
    met = Q._gold(spark, sf_dir).join(Q._hits(spark, sf_dir), ["query_id", "filename"])
    return met.groupBy("query_id").agg(F.max(F.col("rank") <= 5).alias("hit"), F.min("rank").alias("gold_rank"))


@query("e25_keywords", "WITH k AS (SELECT item_id, [substr(text, 1, 4), 'zzzz'] AS keywords, text FROM benchmark) SELECT item_id, len(list_filter(keywords, lambda w: contains(lower(text), lower(w)))) / 2.0 AS hit_rate FROM k")
def keywords(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.array(F.substring("text", 1, 4), F.lit("zzzz")).alias("keywords"), "text")
    return rows.select("item_id", E.keyword_hit_rate(F.col("text"), F.col("keywords")).alias("hit_rate"))


@query("e7_token_efficiency", f"{Q._HITS}, s AS (SELECT query_id, sum(length(text)) AS n FROM hits JOIN chunks ON chunk_id = id GROUP BY 1) SELECT round(avg(length(question) / n), 4) AS token_efficiency FROM questions JOIN s USING (query_id) WHERE n > 0")
def token_efficiency(spark, sf_dir):
    from .tables import questions, stand_ins

    hits = Q._hits(spark, sf_dir).join(chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "text"), "id")
    sizes = hits.groupBy("query_id").agg(F.sum(F.length("text")).alias("n")).where("n > 0")
    return questions(spark, sf_dir).join(sizes, "query_id").agg(F.round(F.avg(F.length("question") / F.col("n")), 4).alias("token_efficiency"))


@query("e28_log_view", "SELECT conv_id, turn, substr(text, 1, 200) AS question, length(text) > 300 AS truncated FROM conversations")
def log_view(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring("text", 1, 200).alias("question"), (F.length("text") > 300).alias("truncated"))


@query("a6_response", f"{Q._HITS} SELECT query_id, id, round(score, 4) AS score, substr(text, 1, 200) AS preview FROM hits JOIN chunks ON chunk_id = id")
def response(spark, sf_dir):
    """The first ten pieces of evidence, as answers carry them."""
    hits = Q._hits(spark, sf_dir).join(chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "text"), "id")
    return hits.where("rank <= 10").select("query_id", "id", F.round("score", 4).alias("score"), F.substring("text", 1, 200).alias("preview"))
