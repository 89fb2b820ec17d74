"""Retrieval as a whole: hybrid search, its stages put together, hop evidence, query variants, gold lookup, model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import needs_rewrite
from . import bm25, fusion, vectors as V

def hybrid(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, asked: DataFrame, fetch: int, domain: str | None = None, index=None) -> DataFrame:
    """Fused hits of vector and lexical search, every question against every chunk.

    ``chunks`` (chunk_id, text, domain if one is asked for), ``vectors`` (vec_id, which is the chunk's id, and embedding), ``questions``
    (query_id, question), ``asked`` (query_id, embedding). With ``domain`` only its chunks are searched, by both ways. ``index`` is a
    lexical index of all chunks (a ``LexicalStore``, say); without one, or with ``domain``, the chunks given are indexed.
    """
    if domain is not None:
        chunks = chunks.where(F.col("domain") == domain)
        vectors = vectors.join(chunks.select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi")
    vec = V.nearest(vectors, asked, fetch).withColumnRenamed("vec_id", "id")
    lex = bm25.search(index if index is not None and domain is None else bm25.build(chunks), questions, fetch).withColumnRenamed("chunk_id", "id")
    return fusion.rrf(vec, lex)


def retrieve(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, asked: DataFrame, k: int, most_per_doc: int = 2, domain: str | None = None, scorer=None) -> DataFrame:
    """The served order: hybrid search over max(2 k, 20) hits, reranking by ``scorer(question, text)`` if there is one, diversity with back-fill, the first k."""
    fetch = max(2 * k, 20)
    fused = hybrid(chunks, vectors, questions, asked, fetch, domain).where(F.col("rank") <= fetch)
    named = fused.join(chunks.select(F.col("chunk_id").alias("id"), "filename", *(["text"] if scorer else [])), "id")
    if scorer is not None:
        named = fusion.reranked(named.join(questions, "query_id"), scorer, fetch)
    return fusion.diversified(named, most_per_doc, k)


def rewritten(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """(query_id, question, variant, text, out_of_domain): what is searched for each question, variant 0 first.

    Questions that pass the rewrite gate are looked up in ``replies`` (query_id, reply), what a model has answered. A reply that only repeats the
    question marks it as out of domain; one that can't be used, or none, leaves the question alone; else the question goes first, its rewrites
    follow. ``out_of_domain`` is null where the gate asked for no rewrite.
    """
    gated = questions.withColumn("gated", needs_rewrite(F.col("question"))).join(replies, "query_id", "left").withColumn("parsed", parsed_rewrites(F.col("reply")))
    same = (F.size("parsed") == 1) & (F.trim(F.col("parsed")[0]) == F.trim(F.col("question")))
    alone = F.array("question")
    texts = F.when(~F.col("gated") | F.col("parsed").isNull() | same, alone).when(F.col("parsed")[0] == F.col("question"), F.col("parsed")).otherwise(F.concat(alone, F.col("parsed")))
    ood = F.when(F.col("gated"), F.coalesce(same, F.lit(False)))
    return gated.select("query_id", "question", ood.alias("out_of_domain"), F.posexplode(texts).alias("variant", "text"))


def served(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, embed, k: int, replies: DataFrame | None = None, most_per_doc: int = 2, domain: str | None = None, index=None, scorer=None) -> DataFrame:
    """(query_id, id, rank, out_of_domain): retrieval as it is served, all questions at once.

    With ``replies`` (a model's answers to the rewrite prompt, as far as it was asked) each question's variants are searched by both ways, their lists fused with the
    question's own weighing more, reranked against the question itself by ``scorer`` if there is one, diversified, and cut to k. Without a model there is vector
    search alone over 2 k hits. ``embed`` turns (query_id, text) into (query_id, embedding).
    """
    named = chunks.select(F.col("chunk_id").alias("id"), "filename", "text")
    if replies is None:
        if domain is not None:
            vectors = vectors.join(chunks.where(F.col("domain") == domain).select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi")
        found = V.nearest(vectors, embed(questions.select("query_id", F.col("question").alias("text"))), 2 * k).withColumnRenamed("vec_id", "id")
        return fusion.diversified(found.join(named.drop("text"), "id"), most_per_doc, k).select("query_id", "id", "rank", F.lit(None).cast("boolean").alias("out_of_domain"))
    fetch = max(2 * k, 20)
    asked = rewritten(questions, replies)
    # a variant is searched under an id of its own
    each = asked.withColumn("search_id", F.to_json(F.struct("query_id", "variant")))
    searched = each.select(F.col("search_id").alias("query_id"), "text")
    hits = hybrid(chunks, vectors, searched.withColumnRenamed("text", "question"), embed(searched), fetch, domain, index).where(F.col("rank") <= fetch)
    lists = hits.select(F.col("query_id").alias("search_id"), "id", "rank").join(each, "search_id").select("query_id", "variant", "id", "rank")
    fused = fusion.weighted_rrf(lists).where(F.col("rank") <= fetch).join(named, "id")
    if scorer is not None:
        fused = fusion.reranked(fused.join(questions, "query_id"), scorer, fetch)
    state = asked.where("variant = 0").select("query_id", "out_of_domain")
    return fusion.diversified(fused, most_per_doc, k).join(state, "query_id").select("query_id", "id", "rank", "out_of_domain")


def parsed_rewrites(reply: Column) -> Column:
    """One to a few queries from a model's reply: numbering and quotes off, four characters at least; null if it has failed."""
    lines = F.transform(F.split(F.trim(reply), "\n"), lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.trim(s), r"^\d+[.、\)\s]+", "")), "^[\"']+|[\"']+$", ""))
    good = F.filter(lines, lambda s: F.length(s) >= 4)
    return F.when(~reply.contains("[LLM 不可用") & (F.size(good) > 0), good)


def parsed_scores(reply: Column, n: int) -> Column:
    """n relevance scores from a reply with a JSON array of numbers or of objects with ``relevance``; null without one."""
    body = F.regexp_extract(F.regexp_replace(reply, r"```(?:json)?", ""), r"(?s)\[.*\]", 0)
    items = F.from_json(body, "array<string>")
    value = lambda x: F.coalesce(F.when(F.substring(x, 1, 1) == "{", F.get_json_object(x, "$.relevance")).otherwise(x).try_cast("double"), F.lit(0.0))
    filled = F.slice(F.concat(F.transform(items, value), F.array_repeat(F.lit(0.0), n)), 1, n)
    return F.when((body != "") & items.isNotNull(), filled)


def hop_evidence(hops: DataFrame, bank: DataFrame, pool: int = 16, keep: int = 3, scorer=fusion.lexical_scorer) -> DataFrame:
    """(query_id, hop, evidence_score, evidence): each hop against the first ``pool`` hits of its question's bank."""
    met = hops.join(bank.where(F.col("rank") <= pool).select("query_id", "id", "rank", "text"), "query_id")
    order = Window.partitionBy("query_id", "hop").orderBy(F.col("rel").desc(), F.col("rank"))
    best = met.withColumn("rel", F.round(scorer(F.col("question"), F.col("text")), 4)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"])
    return best.groupBy("query_id", "hop").agg(F.max("rel").alias("evidence_score"), ids.alias("evidence"))


def final_evidence(per_hop: DataFrame, k: int) -> DataFrame:
    """The hops' evidence one after the other, each id once, the first k: (query_id, id, rank) from (query_id, hop, place, id)."""
    first = per_hop.groupBy("query_id", "id").agg(F.min(F.struct("hop", "place")).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank")


TERM = r"[一-鿿]{2,4}|[A-Za-z][A-Za-z0-9\-]{2,20}"


def variants(questions: DataFrame, hits: DataFrame, first: int = 10, most: int = 4) -> DataFrame:
    """(query_id, variant): the question and the terms that its first hits repeat and it lacks."""
    terms = hits.where(F.col("rank") <= first).select("query_id", "rank", F.posexplode(F.regexp_extract_all("text", F.lit(TERM), 0)).alias("p", "term"))
    counted = terms.join(questions, "query_id").where(~F.col("question").contains(F.col("term"))).groupBy("query_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("rank", "p")).alias("first")).where("n >= 2")
    order = Window.partitionBy("query_id").orderBy(F.col("n").desc(), F.col("first"))
    best = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    added = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), " ")
    return best.groupBy("query_id").agg(added.alias("added")).join(questions, "query_id").select("query_id", F.concat_ws(" ", "question", "added").alias("variant"))
