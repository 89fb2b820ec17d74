"""Queries of vector search, fusion, diversity, expansion, reranking and gold lookup."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import bm25, containment, fusion, retrieval, vectors as V
from ..operators.cells import CellIndex
from ..operators.score_store import ScoreStore
from ..operators.storage import shared_path
from .queries_index import BM25, STATS, scores
from .registry import query
from .tables import CHUNKS, QUESTIONS, VECTORS, chunks, lexical, literal, literal_sql, questions, searched, table, vectors, with_chunks

#: The stated block of query vectors.
BLOCK = "vec_id % 25 = 0"


def _asked(spark, sf_dir):
    return vectors(spark, sf_dir).where(BLOCK).select(F.col("vec_id").alias("query_id"), "embedding", F.col("domain").alias("asked"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_SEARCH = f"""{VECTORS}, asked AS (SELECT vec_id AS query_id, embedding AS query, domain AS asked FROM vectors WHERE {BLOCK}),
scored AS (SELECT query_id, vec_id, asked, domain, list_inner_product(embedding, query) AS score FROM vectors, asked WHERE vec_id <> query_id)"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)"


@query("v1_search", f"WITH {_SEARCH} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM scored) WHERE rank <= 10")
def search(spark, sf_dir):
    return V.search(vectors(spark, sf_dir), _asked(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query("v1_search_filtered", f"WITH {_SEARCH} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, {_RANK} AS rank FROM scored WHERE domain = asked) WHERE rank <= 10")
def search_filtered(spark, sf_dir):
    """the domain filter comes before the top-k."""
    return V.search(vectors(spark, sf_dir), _asked(spark, sf_dir), 10, same=("domain", "asked")).withColumn("score", F.round("score", 6))


@query("v2_cells")
def cells(spark, sf_dir):
    """Approximate search over the stored cell index. The given vectors have no clusters, so recall@10 of 0.9 takes most of the cells."""
    index = CellIndex(spark, shared_path(spark, "cells"))
    index.build(vectors(spark, sf_dir).select("vec_id", "embedding"), nlist=16)
    return index.search(_asked(spark, sf_dir), 10, nprobe=14, itself=False)


@query("v3_cosine", f"WITH {_SEARCH} SELECT query_id, round(avg(list_cosine_similarity(v.embedding, a.query)), 6) AS mean FROM vectors v, asked a WHERE vec_id <> query_id GROUP BY query_id")
def cosine(spark, sf_dir):
    return V.mean_cosines(vectors(spark, sf_dir), _asked(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("v4_compare", f"WITH {_SEARCH}, r AS (SELECT *, {_RANK} AS rank FROM scored) SELECT asked AS domain, round(avg(CASE WHEN rank = 1 THEN score END), 6) AS top1, round(avg(score), 6) AS top5 FROM r WHERE rank <= 5 GROUP BY asked")
def compare(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    found = V.search(vectors(spark, sf_dir), asked, 5).join(asked.select("query_id", "asked"), "query_id")
    return found.groupBy(F.col("asked").alias("domain")).agg(F.round(F.avg(F.when(F.col("rank") == 1, F.col("score"))), 6).alias("top1"), F.round(F.avg("score"), 6).alias("top5"))


# fusion over literal lists and over the corpus --------------------------------------------------

_VEC = "(1, 'a', 1, 0.9), (1, 'b', 2, 0.8), (1, 'c', 3, 0.7), (2, 'x', 1, 0.5)"
_LEX = "(1, 'b', 1, 10.0), (1, 'd', 2, 8.0), (1, 'a', 3, 6.0), (3, 'z', 1, 1.0)"
_COLS = "query_id, id, rank, score"
_LISTS = "WITH " + literal_sql("v", _COLS, _VEC) + ", " + literal_sql("l", _COLS, _LEX)
_FUSED = """f AS (SELECT query_id, id, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) AS score, coalesce(CAST(v.score AS DOUBLE), 0.0) AS vector_score FROM v FULL OUTER JOIN l USING (query_id, id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f)"""


def _lists(spark):
    cast = lambda df: df.withColumn("score", F.col("score").cast("double"))
    return cast(literal(spark, _COLS, _VEC)), cast(literal(spark, _COLS, _LEX))


# Chunks have no vectors of their own in the tables: a chunk's is that of its id modulo the vectors, a question's likewise.
_HYBRID = f"""{BM25}, {VECTORS}, nv AS (SELECT count(*) AS n FROM vectors),
cv AS (SELECT chunk_id, embedding FROM chunks JOIN vectors ON vec_id = (doc_id * 31 + pos) % (SELECT n FROM nv)),
qv AS (SELECT query_id, embedding AS query FROM questions JOIN vectors ON vec_id = (query_id * 7) % (SELECT n FROM nv)),
vs AS (SELECT query_id, chunk_id AS id, list_inner_product(embedding, query) AS score FROM cv, qv),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM vs) WHERE rank <= 20),
l AS (SELECT query_id, chunk_id AS id, rank, score FROM ranked WHERE rank <= 20), {_FUSED}"""


@query("r2_hybrid", f"{_HYBRID} SELECT query_id, id, round(score, 6) AS score, round(vector_score, 6) AS vector_score, rank FROM fused WHERE rank <= 20")
def hybrid(spark, sf_dir):
    found = retrieval.hybrid(*searched(spark, sf_dir), 20, index=lexical(spark, sf_dir))
    return found.where("rank <= 20").select("query_id", "id", F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"), "rank")


_VARIANTS = "(1, 0, 'a', 1), (1, 0, 'b', 2), (1, 1, 'b', 1), (1, 1, 'c', 2), (1, 2, 'c', 1), (1, 2, 'a', 3)"


_HITS = f"{BM25}, hits AS (SELECT query_id, chunk_id AS id, filename, rank FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 20)"


def _hits(spark, sf_dir, k=20):
    source = chunks(spark, sf_dir)
    found = bm25.search(lexical(spark, sf_dir), questions(spark, sf_dir), k)
    return with_chunks(found.withColumnRenamed("chunk_id", "id"), source.select("chunk_id", "filename", "text", "domain", "doc_id", "pos"))


@query("r4_diversity", f"{_HITS} SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY rank) AS n FROM hits) WHERE n <= 2 OR filename = ''")
def diversity(spark, sf_dir):
    return fusion.diversified(_hits(spark, sf_dir)).select("query_id", "id", "rank")


@query("r5_back_fill", f"{_HITS} SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n > 1, rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY rank) AS n FROM hits)) WHERE rank <= 8")
def back_fill(spark, sf_dir):
    return fusion.diversified(_hits(spark, sf_dir), 1, 8).select("query_id", "id", "rank")


@query("r6_retrieve", f"{_HYBRID}, h AS (SELECT query_id, id, filename, fused.rank FROM fused JOIN chunks ON chunk_id = id WHERE fused.rank <= 20) SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n > 2, rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY rank) AS n FROM h)) WHERE rank <= 8")
def retrieve(spark, sf_dir):
    return retrieval.retrieve(*searched(spark, sf_dir), 8).select("query_id", "id", "rank")


_LEXICAL = r"""CAST(len(list_intersect(regexp_extract_all(lower(question), '\w+'), regexp_extract_all(lower(text), '\w+'))) AS DOUBLE) / greatest(len(list_distinct(regexp_extract_all(lower(question), '\w+'))), 1)"""

# Served retrieval: a third of the questions has two rewrites, a third a reply that repeats it, a third none.
_REPLY = "CASE query_id % 3 WHEN 0 THEN '1. ' || substr(question, 1, 40) || chr(10) || '2) ' || substr(question, 21, 60) WHEN 1 THEN question END"
_SERVED = f"""WITH {CHUNKS}, {QUESTIONS.replace("questions AS", "base AS")}, texts AS (SELECT query_id, question, CASE query_id % 3 WHEN 0 THEN [question, trim(substr(question, 1, 40)), trim(substr(question, 21, 60))] ELSE [question] END AS t FROM base),
questions AS (SELECT query_id * 10 + generate_subscripts(t, 1) - 1 AS query_id, unnest(t) AS question FROM texts), {STATS}, {scores(1.5, 0.75)}, {VECTORS}, nv AS (SELECT count(*) AS n FROM vectors),
cv AS (SELECT chunk_id, embedding FROM chunks JOIN vectors ON vec_id = (doc_id * 31 + pos) % (SELECT n FROM nv)),
qv AS (SELECT query_id, embedding AS query FROM questions JOIN vectors ON vec_id = ((query_id // 10) * 7 + (query_id % 10) * 13) % (SELECT n FROM nv)),
vs AS (SELECT query_id, chunk_id AS id, list_inner_product(embedding, query) AS score FROM cv, qv),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM vs) WHERE rank <= 20),
l AS (SELECT query_id, chunk_id AS id, rank, score FROM ranked WHERE rank <= 20), {_FUSED},
w AS (SELECT query_id // 10 AS query_id, id, sum(CASE WHEN query_id % 10 = 0 THEN 1.5 ELSE 1.0 END / (60 + rank)) AS score FROM fused WHERE rank <= 20 GROUP BY 1, 2),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM w) WHERE place <= 20),
s AS (SELECT h.query_id, h.id, filename, row_number() OVER (PARTITION BY h.query_id ORDER BY round({_LEXICAL}, 4) DESC, place) AS rank FROM h JOIN chunks ON chunk_id = h.id JOIN base b ON b.query_id = h.query_id),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY rank) AS n FROM s)
SELECT query_id, id, rank, query_id % 3 = 1 AS out_of_domain FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n > 2, rank) AS rank FROM d) WHERE rank <= 8""".replace(r"\w", "[a-z0-9_]")


@query("r6_served", _SERVED)
def served(spark, sf_dir):
    """The whole served retrieval: rewrite gate, a model's rewrites, both searches, weighted fusion, reranking, diversity, out-of-domain state."""
    source, of_chunk, asked, _ = searched(spark, sf_dir)
    base = vectors(spark, sf_dir).select("vec_id", "embedding")
    n = base.count()

    def embed(texts):
        of = F.from_json("query_id", "query_id long, variant long")
        at = texts.select("query_id", ((of["query_id"] * 7 + of["variant"] * 13) % n).alias("vec_id"))
        return at.join(base, "vec_id").select("query_id", "embedding")

    replies = asked.select("query_id", F.expr(_REPLY).alias("reply"))
    return retrieval.served(source, of_chunk, asked, embed, 8, replies, index=lexical(spark, sf_dir), scorer=fusion.lexical_scorer)


_REPLIES = "(1, '1. first query\n2、second query\nabc'), (2, '[LLM 不可用]'), (3, '  '), (4, '\"quoted query text\"')"
_REPLIES_SQL = _REPLIES.replace("\n", "' || chr(10) || '")


@query("r8_rerank", f"{_HITS}, s AS (SELECT query_id, hits.id, hits.rank AS place, round(({_LEXICAL}), 4) AS rerank_score FROM hits JOIN chunks ON chunk_id = hits.id JOIN questions USING (query_id) WHERE hits.rank <= 16) SELECT query_id, id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, place) AS rank FROM s) WHERE rank <= 5".replace(r"\w", "[a-z0-9_]"))
def rerank(spark, sf_dir):
    hits = _hits(spark, sf_dir).join(questions(spark, sf_dir), "query_id")
    return fusion.reranked(hits, fusion.lexical_scorer, 5, 16).select("query_id", "id", "rerank_score", "rank")


def lexical_scores(asked: list[str], texts: list[str]) -> list[float]:
    """A stand-in for a reranking model, in batches: the share of the question's words that the text has."""
    words = [[set(re.findall(r"[a-z0-9_]+", s.lower())) for s in rows] for rows in (asked, texts)]
    return [len(a & b) / max(1, len(a)) for a, b in zip(*words, strict=True)]


@query("r9_scored_once", f"{_HITS} SELECT count(*) AS hits, count(DISTINCT (query_id, id)) AS pairs FROM hits")
def scored_once(spark, sf_dir):
    """All hits are reranked twice: the scorer is asked for each pair once."""
    store = ScoreStore(spark, shared_path(spark, "scores"), lexical_scores)
    hits = _hits(spark, sf_dir).join(questions(spark, sf_dir).withColumn("question", F.concat_ws(" ", "query_id", "question")), "query_id").select("query_id", "id", "question", "text", "rank")
    for _ in range(2):
        found = store.scored(hits)
    return found.where("rerank_score is not null").agg(F.count("*").alias("hits")).withColumn("pairs", F.lit(store.count()).cast("long"))


_STORED = f"""{_HITS}, s AS (SELECT query_id, hits.id, hits.rank AS place, round(({_LEXICAL}), 4) AS rerank_score FROM hits JOIN chunks ON chunk_id = hits.id JOIN questions USING (query_id))
SELECT query_id, id, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, place) AS rank FROM s) WHERE rank <= 5"""


@query("r9_score_store", _STORED.replace(r"\w", "[a-z0-9_]"))
def score_store(spark, sf_dir):
    """Reranking from the store: half of the pairs have their score from a call before."""
    store = ScoreStore(spark, shared_path(spark, "scores"), lexical_scores)
    hits = _hits(spark, sf_dir).join(questions(spark, sf_dir), "query_id").select("query_id", "id", "question", "text", "rank")
    store.scored(hits.where("rank % 2 = 0"))
    return store.reranked(hits, 5).select("query_id", "id", F.round("rerank_score", 4).alias("rerank_score"), "rank")


@query("r11_small_to_big", f"{_HITS} SELECT query_id, id, rank, md5(coalesce(p.text, '')) AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY rank) AS n FROM hits) h JOIN (SELECT filename, text FROM chunks WHERE pos = 0) p USING (filename) WHERE n = 1 OR p.text = ''")
def small_to_big(spark, sf_dir):
    # the parent of a chunk is its document's first line
    parent = chunks(spark, sf_dir).where("pos = 0").select("filename", F.col("text").alias("parent_content"))
    hits = _hits(spark, sf_dir).join(parent, "filename").withColumn("parent_content", F.concat("filename", F.lit("|"), "parent_content"))
    found = fusion.expanded(hits)
    return found.select("query_id", "id", "rank", F.md5(F.expr("substring(text, length(filename) + 2)")).alias("text"))


_BANK = "(1, 'a', 0.5), (1, 'b', 0.4)"
_NEW = "(1, 'b', 0.9), (1, 'c', 0.3), (2, 'z', 0.1)"


@query("r13_hop_evidence", f"{_HITS}, hops AS (SELECT query_id, generate_subscripts(string_split(question, '. '), 1) AS hop, unnest(string_split(question, '. ')) AS question FROM questions), s AS (SELECT query_id, hop, hits.id, hits.rank, round(({_LEXICAL}), 4) AS rel FROM hops JOIN hits USING (query_id) JOIN chunks ON chunk_id = hits.id WHERE hits.rank <= 16), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, hop ORDER BY rel DESC, rank) AS n FROM s) SELECT query_id, hop, max(rel) AS evidence_score, list(id ORDER BY n) AS evidence FROM r WHERE n <= 3 GROUP BY query_id, hop".replace(r"\w", "[a-z0-9_]"))
def hop_evidence(spark, sf_dir):
    hops = questions(spark, sf_dir).select("query_id", F.posexplode(F.split("question", r"\. ", -1)).alias("hop", "question")).withColumn("hop", F.col("hop") + 1)
    return retrieval.hop_evidence(hops, _hits(spark, sf_dir))


@query("r15_variant", f"{_HITS}, t AS (SELECT query_id, rank, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]{{2,20}}'), 1) AS p, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\\-]{{2,20}}')) AS term FROM hits JOIN chunks ON chunk_id = id WHERE rank <= 10), c AS (SELECT query_id, term, count(*) AS n, min(rank * 1000000 + p) AS first FROM t JOIN questions USING (query_id) WHERE NOT contains(question, term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first) AS k FROM c WHERE n >= 2) SELECT query_id, question || ' ' || string_agg(term, ' ' ORDER BY k) AS variant FROM r JOIN questions USING (query_id) WHERE k <= 4 GROUP BY query_id, question")
def variant(spark, sf_dir):
    return retrieval.variants(questions(spark, sf_dir), _hits(spark, sf_dir))


@query("r18_gold", r"WITH q AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS s FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents), e AS (SELECT item_id, doc_id, 'exact' AS how FROM q, d WHERE contains(t, s)), f AS (SELECT item_id, doc_id, 'prefix' FROM q, d WHERE length(substr(s, 1, 30)) >= 8 AND contains(t, substr(s, 1, 30)) AND item_id NOT IN (SELECT item_id FROM e)) SELECT * FROM e UNION ALL SELECT * FROM f")
def gold(spark, sf_dir):
    return containment.gold_lookup(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("sentence")), table(spark, sf_dir, "documents").select("doc_id", "text"))
