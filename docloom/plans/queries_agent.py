"""Queries of gates, answers, decisions, the batch agent, caches and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import agent, bm25, caches, gates, retrieval
from .queries_search import _HYBRID
from .queries_text import _Q, _questions
from .registry import query
from .tables import VECTORS, chunks, documents, lexical, literal, literal_sql, questions, searched, split_columns, table, vectors, with_chunks


def _hits(spark, sf_dir):
    found = retrieval.hybrid(*searched(spark, sf_dir), 20, index=lexical(spark, sf_dir)).where("rank <= 8")
    return with_chunks(found, chunks(spark, sf_dir).select("chunk_id", "text", "filename"))


_TOP = f"{_HYBRID}, h AS (SELECT query_id, id, fused.rank, vector_score, text, chunks.filename, EXISTS (SELECT 1 FROM l WHERE l.query_id = fused.query_id AND l.id = fused.id) AS lex FROM fused JOIN chunks ON chunk_id = id WHERE fused.rank <= 8)"
_G3 = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"
_REL = f"""{_TOP}, g AS (SELECT query_id, rank, vector_score, lex, {_G3.format("lower(question)")} AS own, {_G3.format("lower(substr(text, 1, 500))")} AS other FROM h JOIN questions USING (query_id)),
a AS (SELECT query_id, min_by(vector_score, rank) AS top1, avg(vector_score) AS mean, avg(len(list_intersect(own, other)) / len(own)) AS overlap, bool_or(rank <= 3 AND lex) AS support FROM g GROUP BY query_id),
r AS (SELECT *, top1 * 0.6 + overlap * 0.4 AS combined FROM a),
verdict AS (SELECT *, CASE WHEN top1 < 0.10 AND overlap < 0.02 THEN 'too_low' WHEN overlap < 0.01 AND NOT support THEN 'no_overlap' WHEN combined + (CASE WHEN support THEN 0.05 ELSE 0 END) >= 0.25 THEN 'combined' WHEN top1 > 0.60 AND overlap > 0.05 THEN 'semantic' ELSE 'below' END AS reason FROM r)"""


@query("g1_relevance", f"{_REL} SELECT query_id, round(top1, 4) AS top1_score, round(mean, 4) AS avg_score, round(overlap, 4) AS overlap, support AS bm25_support, reason, reason IN ('combined', 'semantic') AS is_relevant FROM verdict")
def relevance(spark, sf_dir):
    found = gates.relevance(questions(spark, sf_dir), _hits(spark, sf_dir))
    return found.select("query_id", F.round("top1_score", 4).alias("top1_score"), F.round("avg_score", 4).alias("avg_score"), F.round("overlap", 4).alias("overlap"), "bm25_support", "reason", "is_relevant")


_EV = "ev AS (SELECT query_id, lower(string_agg(substr(text, 1, 800), ' ' ORDER BY rank)) AS evidence FROM h WHERE rank <= {0} GROUP BY query_id), en AS (SELECT query_id, question, evidence, list_distinct(regexp_extract_all(lower(question), '[a-z][a-z0-9\\-]{{2,}}')) AS e FROM questions JOIN ev USING (query_id))"


@query("g2_entity_overlap", f"{_TOP}, {_EV.format(8)} SELECT query_id, round(CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_filter(e, lambda x: contains(evidence, x))) / len(e) END, 6) AS entity_overlap FROM en")
def entity_overlap(spark, sf_dir):
    return gates.entity_overlap(questions(spark, sf_dir), _hits(spark, sf_dir), 8, 1.0).select("query_id", F.round("entity_overlap", 6).alias("entity_overlap"))


@query("g3_shared_token", f"{_TOP} SELECT query_id, id, list_has_any(regexp_extract_all(lower(question), '[a-z][a-z0-9\\-]{{2,}}'), regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{2,}}')) OR len(list_intersect(list_distinct(list_transform(range(1, length(question)), lambda i: lower(substr(question, i, 2)))), list_distinct(list_transform(range(1, length(text)), lambda i: lower(substr(text, i, 2)))))) >= 2 AS shared FROM h JOIN questions USING (query_id)")
def shared_token(spark, sf_dir):
    return _hits(spark, sf_dir).join(questions(spark, sf_dir), "query_id").select("query_id", "id", gates.has_shared_token(F.col("question"), F.col("text")).alias("shared"))


@query("g4_related", f"{_TOP}, ev AS (SELECT query_id, lower(string_agg(substr(text, 1, 600), ' ' ORDER BY rank)) AS evidence FROM h WHERE rank <= 5 GROUP BY query_id) SELECT query_id, NOT regexp_matches(question, '(?i){'|'.join(X.OUT_OF_DOMAIN)}') AND len(list_filter(regexp_extract_all(lower(question), '[a-z][a-z0-9\\-]{{2,}}'), lambda x: contains(evidence, x))) > 0 AS related FROM questions JOIN ev USING (query_id)")
def related(spark, sf_dir):
    return gates.topically_related(questions(spark, sf_dir), _hits(spark, sf_dir))


@query("g5_domain_gate", f"{_REL}, {_EV.format(8)}, o AS (SELECT query_id, question, CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_filter(e, lambda x: contains(evidence, x))) / len(e) END AS share FROM en), b AS (SELECT query_id, reason IN ('combined', 'semantic') AS rel, (regexp_matches(question, '(?i){'|'.join(X.OUT_OF_DOMAIN)}') AND overlap < 0.15) OR share < 0.08 AS out FROM verdict JOIN o USING (query_id)) SELECT query_id, rel AND NOT out AS is_relevant, rel AND out AS is_refusal FROM b")
def domain_gate(spark, sf_dir):
    asked, hits = questions(spark, sf_dir), _hits(spark, sf_dir)
    return gates.domain_gate(gates.relevance(asked, hits), gates.entity_overlap(asked, hits, 8, 1.0)).select("query_id", "is_relevant", "is_refusal")


# answers ---------------------------------------------------------------------------------------

_ANSWERS = "(1, 'x [1] and [2][10]. y [7]', 10), (2, 'none', 3), (3, '[1]', 0), (4, 'no cite', 0), (5, '[3][3][2]', 3)"


_RAW = [
    (1, '```json\n{"diagnosis": "d", "confidence": "high", "evidence": ["a [1]"]}\n```', True),
    (2, '{"diagnosis": "d", "confidence": "high", "evidence": ["a [9]"]}', False),
    (3, '{"diagnosis": "d"}', False),
    (4, "[1, 2]", False),
    (5, "not json", False),
    (6, 'text first ```{"diagnosis": "d", "confidence": "low", "evidence": []}```', True),
]


_CLAIMS = r"""WITH a AS (SELECT item_id AS query_id, text AS answer, (SELECT text FROM documents WHERE doc_id = item_id) AS evidence FROM benchmark),
s AS (SELECT query_id, evidence, generate_subscripts(list_filter(list_transform(regexp_split_to_array(answer, '[。！？；\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 6), 1) - 1 AS n, unnest(list_filter(list_transform(regexp_split_to_array(answer, '[。！？；\n]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 6)) AS claim FROM a),
j AS (SELECT query_id, n, CASE WHEN regexp_matches(claim, '^[*>\-#\d.\[\]（）()\s]+$') OR contains(substr(claim, 1, 4), '**') THEN 'unverifiable' WHEN len(list_intersect(list_distinct(string_split(claim, '')), list_distinct(string_split(evidence, '')))) / len(list_distinct(string_split(claim, ''))) >= 0.6 THEN 'supported' ELSE 'unsupported' END AS status FROM s)"""


def _claims(spark, sf_dir):
    evidence = documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("text").alias("evidence"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"))
    return gates.claims(asked.join(evidence, "query_id"))


@query("g9_claims", f"{_CLAIMS} SELECT query_id, n, status FROM j")
def claims(spark, sf_dir):
    return _claims(spark, sf_dir).select("query_id", "n", "status")


@query("e19_groundedness", f"{_CLAIMS}, q AS (SELECT query_id, avg(CASE WHEN status = 'supported' THEN 1.0 ELSE 0 END) AS g FROM j WHERE status <> 'unverifiable' GROUP BY 1) SELECT (SELECT round(avg(g), 3) FROM q) AS groundedness, round(sum(CASE WHEN status = 'unsupported' THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN status <> 'unverifiable' THEN 1 ELSE 0 END), 1), 3) AS unsupported_claim_rate FROM j")
def groundedness(spark, sf_dir):
    from ..operators import evaluation

    return evaluation.groundedness(_claims(spark, sf_dir))


@query("g12_prompt", f"{_TOP} SELECT query_id, md5(string_agg('[' || rank || '] 文件: ' || filename || chr(10) || text || chr(10), chr(10) ORDER BY rank)) AS context FROM h GROUP BY query_id")
def prompt(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("section_title", F.lit("")).withColumn("parent_content", F.lit(None).cast("string"))
    return gates.prompt_context(hits).select("query_id", F.md5("context").alias("context"))


@query("g20_cache_key", "SELECT doc_id, sha256(text || ':' || lang) AS key FROM documents")
def cache_key(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", gates.cache_key(F.col("text"), F.col("lang")).alias("key"))


# decisions -------------------------------------------------------------------------------------

# Every event is a state: a question in turn, the other columns from the event.
_STATE_QUESTIONS = "(0, 'A是什么？B是什么的详细定义呢？'), (1, '窗宽和窗位的区别'), (2, '2026 年新指南'), (3, 'plain question'), (4, 'GDP 增长'), (5, 'another plain question')"
_STATE = """event_id AS id, question, round(value / 40, 2) AS top1, (event_id % 5) / 4.0D AS comp, (event_id % 3) / 2.0D AS lexical, CAST(user_id % 3 AS INT) AS n_hops, event_id % 4 = 0 AS missing_hop, event_id % 7 < 3 AS decomposed, CAST(event_id % 4 AS INT) AS budget, CAST(user_id % 4 AS INT) AS iteration,
 CASE event_type WHEN 'view' THEN 'sufficient' WHEN 'click' THEN 'needs_decomposition' WHEN 'error' THEN 'unsupported' ELSE 'insufficient' END AS grade, CASE WHEN event_id % 3 = 0 THEN '未提及' WHEN event_id % 3 = 1 THEN '无相关' ELSE '' END AS grade_reason"""
_S = "WITH " + literal_sql("c", "k, question", _STATE_QUESTIONS) + ", s AS (SELECT " + _STATE.replace("4.0D", "4.0").replace("2.0D", "2.0") + " FROM events JOIN c ON c.k = event_id % 6)"
_MULTI = r"(len(regexp_extract_all(question, '[?？]')) >= 2)"
_COMP = r"(regexp_matches(question, '区别|对比|异同'))"
_OOD = f"regexp_matches(question, '(?i){'|'.join(X.OUT_OF_DOMAIN)}')"
_VERDICT = f"""v AS (SELECT *, CASE WHEN {_MULTI} AND n_hops = 0 AND NOT decomposed THEN 'DECOMPOSE' WHEN {_COMP} AND n_hops = 0 AND NOT decomposed THEN 'UNCERTAIN' WHEN regexp_matches(question, '(?:20|19)\\d{{2}}\\s*年') THEN 'UNCERTAIN'
 WHEN n_hops > 0 AND comp >= 1 THEN 'ACCEPT' WHEN n_hops = 0 AND top1 >= 0.5 THEN CASE WHEN {_OOD} OR lexical <= 0 THEN 'UNCERTAIN' ELSE 'ACCEPT' END
 WHEN n_hops = 0 AND top1 < 0.05 THEN CASE WHEN {_OOD} THEN 'ABSTAIN' WHEN budget > 0 AND iteration < 2 THEN 'RETRIEVE' ELSE 'ABSTAIN' END
 WHEN n_hops > 0 THEN CASE WHEN NOT missing_hop THEN 'UNCERTAIN' WHEN budget > 0 THEN 'RETRIEVE' ELSE 'ABSTAIN' END ELSE 'UNCERTAIN' END AS verdict FROM s)"""


def _states(spark, sf_dir):
    cases = literal(spark, "k, question", _STATE_QUESTIONS)
    return table(spark, sf_dir, "events").join(F.broadcast(cases), F.col("k") == F.col("event_id") % 6).selectExpr(*split_columns(_STATE))


@query("g17_verdict", _S + f", {_VERDICT} SELECT id, verdict FROM v")
def verdict(spark, sf_dir):
    return gates.signal_verdict(_states(spark, sf_dir)).select("id", "verdict")


@query("g19_decision", _S + f""", {_VERDICT} SELECT id, CASE WHEN verdict <> 'UNCERTAIN' THEN verdict WHEN grade = 'sufficient' THEN 'ACCEPT' WHEN grade = 'needs_decomposition' THEN 'DECOMPOSE'
 WHEN (grade = 'unsupported' OR (grade = 'insufficient' AND regexp_matches(grade_reason, '未提及|未找到|不存在|没有提及|无相关'))) AND NOT (({_MULTI} OR {_COMP}) AND n_hops = 0) THEN CASE WHEN budget > 0 AND iteration < 2 THEN 'RETRIEVE' ELSE 'ABSTAIN' END
 WHEN ({_MULTI} OR {_COMP}) AND n_hops = 0 AND NOT decomposed THEN 'DECOMPOSE' WHEN budget > 0 AND iteration < 2 THEN 'RETRIEVE' ELSE 'ABSTAIN' END AS decision, CASE WHEN verdict <> 'UNCERTAIN' THEN 'cheap_signal' ELSE 'grader' END AS mode FROM v""")
def decision(spark, sf_dir):
    return gates.decided(_states(spark, sf_dir)).select("id", "decision", "mode")


_HOPS = "(1, 1, 0.9, true), (1, 2, 0.3, true), (2, 1, 0.5, true), (2, 2, 0.01, false), (3, 1, 0.04, true)"


@query("a3_plan", _Q + " SELECT id, list_filter(list_transform(string_split(replace(q, '?', '？'), '？'), lambda p: trim(p)), lambda p: p <> '') AS plan FROM q_")
def plan(spark, sf_dir):
    return _questions(spark, sf_dir).select("id", gates.plan(F.col("q")).alias("plan"))


def _search(spark, sf_dir):
    source = chunks(spark, sf_dir)
    index = lexical(spark, sf_dir)

    def search(asked):
        found = with_chunks(bm25.search(index, asked, 10).withColumnRenamed("chunk_id", "id"), source.select("chunk_id", "text"))
        return found.select("query_id", "id", "rank", "score", "text", (F.col("score") / (F.col("score") + 20)).alias("vector_score"), F.lit("bm25").alias("sources"))

    return search


@query("a1_agent")
def run_agent(spark, sf_dir):
    """The bounded agent over all benchmark questions, and one of two parts for each pair of them."""
    asked = questions(spark, sf_dir)
    pairs = asked.where("query_id % 2 = 0").join(asked.select((F.col("query_id") - 1).alias("query_id"), F.col("question").alias("second")), "query_id").select((F.col("query_id") + 10_000).alias("query_id"), F.concat("question", F.lit("? "), "second", F.lit("?")).alias("question"))
    return agent.run(asked.unionByName(pairs), _search(spark, sf_dir))


# caches ----------------------------------------------------------------------------------------

_CACHE = f"{VECTORS}, e AS (SELECT vec_id AS key, embedding, vec_id % 50 AS inserted_at FROM vectors WHERE vec_id % 25 <> 0), r AS (SELECT vec_id AS query_id, embedding AS query FROM vectors WHERE vec_id % 25 = 0)"


@query("l2_semantic_cache", f"WITH {_CACHE} SELECT query_id, min_by(key, inserted_at * 1000000 + key) AS key FROM e, r WHERE list_cosine_similarity(embedding, query) >= 0.2 GROUP BY query_id")
def semantic_cache(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    entries = rows.where("vec_id % 25 <> 0").select(F.col("vec_id").alias("key"), "embedding", (F.col("vec_id") % 50).alias("inserted_at"))
    return caches.semantic(rows.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), entries, 0.2)


@query("l2_exact_cache", "SELECT b.item_id, b.item_id % 3 = 0 AS hit FROM benchmark b")
def exact_cache(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id", gates.cache_key(F.col("text")).alias("key"))
    entries = asked.where("item_id % 3 = 0").select("key", F.lit(True).alias("value"))
    return caches.exact(asked, entries).select("item_id", F.coalesce("value", F.lit(False)).alias("hit"))


@query("l1_ttl", "SELECT event_id FROM events WHERE value IS NOT NULL AND epoch(ts) + 3600 > epoch((SELECT max(ts) FROM events)) - 86400")
def ttl(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value is not null")
    last = events.agg(F.max("ts").alias("last"))
    entries = events.crossJoin(F.broadcast(last)).withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return caches.alive(entries, F.col("last") - F.expr("INTERVAL 1 DAY")).select("event_id")


@query("l1_lru")
def lru(spark, sf_dir):
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 16).cast("string").alias("cache"), F.col("ts").cast("timestamp").cast("double").alias("at"), F.col("user_id").cast("string").alias("key"))
    return caches.replay(log, 20, 86400.0)


# streams ---------------------------------------------------------------------------------------


@query("w1_directory_watcher", "SELECT 'd' || doc_id || '.txt' AS filename, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def watched(spark, sf_dir):
    """Documents arrive in watched folders as files, in two lots; each is taken up once over three runs of the streams."""
    from ..operators.storage import shared_path
    from ..sources.document_files import write_files
    from ..streaming import watcher

    base = shared_path(spark, "watch")
    folders = max(1, -(-documents(spark, sf_dir).count() // watcher.FOLDER))
    files = documents(spark, sf_dir).where("text is not null").select("doc_id", F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(folders)), F.lit("/d"), F.col("doc_id"), F.lit(".txt")).alias("relative"), F.col("text").alias("content"))
    others = files.where("doc_id % 10 = 0").withColumn("relative", F.concat("relative", F.lit(".docx")))
    for lot in (files.where("doc_id % 2 = 0").unionByName(others), files.where("doc_id % 2 <> 0"), files.limit(0)):
        write_files(lot, f"{base}/in")
        for i in range(folders):
            watcher.ingest(watcher.read(spark, f"{base}/in/{i}", max_files=100_000), f"{base}/out/{i}", f"{base}/state/{i}")
            watcher.take_empty(spark, f"{base}/in/{i}", f"{base}/empty/{i}")
    taken = reduce(DataFrame.unionByName, [spark.read.schema("filename string, text string").parquet(f"{base}/{part}/{i}") for part in ("out", "empty") for i in range(folders)])
    return taken.select("filename", F.length("text").alias("chars"))


# files: documents as text, one in fifty of them broken, one of a kind that isn't known, one a PDF without a reader
_FILES = """SELECT 'd' || doc_id || CASE doc_id % 50 WHEN 9 THEN '.docx' WHEN 11 THEN '.pdf' ELSE '.txt' END AS filename, CASE WHEN doc_id % 3 = 0 THEN 'general' ELSE lang END AS domain,
CASE doc_id % 50 WHEN 9 THEN 'docx' WHEN 11 THEN 'pdf' ELSE 'txt' END AS file_type, CASE WHEN doc_id % 50 NOT IN (7, 9, 11) THEN md5(text) END AS text, CASE doc_id % 50 WHEN 7 THEN 'UnicodeDecodeError' WHEN 9 THEN 'ValueError' WHEN 11 THEN 'ValueError' END AS error FROM documents WHERE text IS NOT NULL"""


def _files(spark, sf_dir):
    from ..operators.storage import shared_path
    from ..sources.document_files import write_files

    n = F.col("doc_id") % 50
    name = F.concat(F.lit("d"), F.col("doc_id"), F.when(n == 9, ".docx").when(n == 11, ".pdf").otherwise(".txt"))
    content = F.when(n == 7, F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    folder = shared_path(spark, "files")
    write_files(documents(spark, sf_dir).where("text is not null").select(F.when(F.col("doc_id") % 3 == 0, name).otherwise(F.concat_ws("/", "lang", name)).alias("relative"), content.alias("content")), folder)
    return folder


def _loaded(df):
    return df.select("filename", "domain", "file_type", F.md5("full_text").alias("text"), F.regexp_extract("error", "^[A-Za-z]+", 0).alias("error"))


@query("s7_load_files", _FILES)
def load_files(spark, sf_dir):
    """A folder of documents through the file source: bad files have a row with their error."""
    from ..sources import document_files

    return _loaded(document_files.load(spark, _files(spark, sf_dir)))


@query("s7_file_stream", _FILES)
def file_stream(spark, sf_dir):
    """The same folder as a stream that is run twice."""
    from ..operators.storage import shared_path
    from ..sources import document_files

    folder, base = _files(spark, sf_dir), shared_path(spark, "files-stream")
    for _ in range(2):
        document_files.stream(spark, folder).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return _loaded(spark.read.parquet(f"{base}/out"))
