"""Queries of fusion, answers, decisions and audits, each over records that are derived from the given tables.

What stands in for what: events are hits of a user's list, hops, routes and states; conversations are answers, replies and questions; orders are a registry of
cases; customers are described collections; benchmark items are questions with a model's rewrites.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, evaluation as E, fusion, gates, retrieval
from .queries_text import QUESTIONS, dealt_sql, s_
from .registry import query
from .tables import CHUNKS, VECTORS, chunks, documents, literal, split_columns, table, vectors

# fusion: a user's events are two ranked lists that overlap ----------------------------------------

_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"
_LISTS = f"""WITH e AS (SELECT user_id AS query_id, event_id AS id, value AS score, event_type FROM events), v AS (SELECT query_id, id, score, {_RANK} AS rank FROM e WHERE event_type IN ('view', 'click', 'error')), l AS (SELECT query_id, id, score, {_RANK} AS rank FROM (SELECT query_id, id, 100 - score AS score FROM e WHERE event_type IN ('click', 'purchase'))),
f AS (SELECT query_id, id, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) AS score, coalesce(v.score, 0.0) AS vector_score FROM v FULL OUTER JOIN l USING (query_id, id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f)"""


def _hits(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"), "event_type")


def _ranked(rows):
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))


def _lists(spark, sf_dir):
    e = _hits(spark, sf_dir)
    return _ranked(e.where("event_type in ('view', 'click', 'error')")), _ranked(e.where("event_type in ('click', 'purchase')").withColumn("score", 100 - F.col("score")))


@query("r1_rrf", f"{_LISTS} SELECT query_id, id, round(CAST(score AS DOUBLE), 6) AS score, vector_score, rank FROM fused")
def rrf(spark, sf_dir):
    return fusion.rrf(*_lists(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"), "vector_score", "rank")


@query("r2_padded", f"{_LISTS}, top AS (SELECT query_id, id, 0 AS part, rank FROM fused WHERE rank <= 2), both_ AS (SELECT * FROM top UNION ALL SELECT query_id, id, 1, rank FROM v WHERE (query_id, id) NOT IN (SELECT query_id, id FROM top)) SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank FROM both_) WHERE rank <= 5")
def pad(spark, sf_dir):
    vec, lex = _lists(spark, sf_dir)
    return fusion.padded(fusion.rrf(vec, lex).where("rank <= 2"), vec, 5)


@query("r3_weighted_rrf", "WITH e AS (SELECT user_id AS query_id, event_id % 3 AS variant, event_id % 17 AS id, min(value) AS score FROM events GROUP BY 1, 2, 3), t AS (SELECT query_id, variant, id, row_number() OVER (PARTITION BY query_id, variant ORDER BY score, id) AS rank FROM e), s AS (SELECT query_id, id, sum((CASE WHEN variant = 0 THEN 1.5 ELSE 1.0 END) / (60 + rank)) AS score FROM t GROUP BY 1, 2) SELECT query_id, id, round(CAST(score AS DOUBLE), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s")
def weighted(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query_id"), (F.col("event_id") % 3).alias("variant"), (F.col("event_id") % 17).alias("id")).agg(F.min("value").alias("score"))
    lists = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "variant").orderBy("score", "id")))
    return fusion.weighted_rrf(lists).withColumn("score", F.round("score", 6))


@query("r12_accumulate", "WITH e AS (SELECT user_id AS query_id, event_id AS id, value AS score, event_type FROM events), b AS (SELECT * FROM e WHERE event_type IN ('view', 'click')), n AS (SELECT query_id, id, score / 2 AS score FROM e WHERE event_type IN ('click', 'error')) SELECT query_id, id, coalesce(n.score, b.score) AS score, CASE WHEN b.id IS NULL THEN 1 ELSE 0 END AS since FROM b FULL OUTER JOIN n USING (query_id, id)")
def accumulate(spark, sf_dir):
    e = _hits(spark, sf_dir)
    return fusion.accumulated(e.where("event_type in ('view', 'click')"), e.where("event_type in ('click', 'error')").withColumn("score", F.col("score") / 2))


@query("r14_final_evidence", "WITH e AS (SELECT user_id AS query_id, 1 + event_id % 3 AS hop, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY value, event_id) AS place, event_id % 11 AS id FROM events), f AS (SELECT query_id, id, min((hop, place)) AS o FROM e GROUP BY 1, 2) SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rank FROM f) WHERE rank <= 3")
def final_evidence(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("hop", F.col("event_id") % 3)
    place = F.row_number().over(Window.partitionBy("user_id", "hop").orderBy("value", "event_id"))
    return retrieval.final_evidence(e.select(F.col("user_id").alias("query_id"), (F.col("hop") + 1).alias("hop"), place.alias("place"), (F.col("event_id") % 11).alias("id")), 3)


# replies of models -----------------------------------------------------------------------------

_REPLY = "CASE item_id % 4 WHEN 0 THEN '1. ' || substr(text, 1, 30) || chr(10) || '2、' || substr(text, 31, 25) || chr(10) || 'abc' WHEN 1 THEN '[LLM 不可用] ' || text WHEN 2 THEN '\"' || substr(text, 1, 40) || '\"' ELSE '  ' END"


@query("r7_rewrites", f"WITH t AS (SELECT item_id AS id, {_REPLY} AS reply FROM benchmark)" + r""", l AS (SELECT id, list_filter(list_transform(string_split(trim(reply), chr(10)), lambda s: trim(trim(regexp_replace(trim(s), '^\d+[.、\)\s]+', '')), '"''')), lambda s: length(s) >= 4) AS lines, contains(reply, '[LLM 不可用') AS failed FROM t)
SELECT id, CASE WHEN NOT failed AND len(lines) > 0 THEN lines END AS queries FROM l""")
def rewrites(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), retrieval.parsed_rewrites(F.expr(_REPLY)).alias("queries"))


@query("r10_rerank_reply", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN [value, 0.0, 0.0, CAST(user_id AS DOUBLE)] WHEN 1 THEN [CAST(user_id AS DOUBLE), value, 0.0, 0.0] END AS scores FROM events")
def rerank_reply(spark, sf_dir):
    reply = """CASE event_id % 3 WHEN 0 THEN '```json\\n[{"relevance": ' || value || '}, {"relevance": "x"}, {}, ' || user_id || ', 7]\\n```' WHEN 1 THEN 'scores: [' || user_id || ', ' || value || ']' ELSE props END"""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), retrieval.parsed_scores(F.expr(reply), 4).alias("scores"))


@query("g10_claim_reply", "SELECT conv_id, turn, CASE WHEN turn % 4 = 0 AND trim(text) <> '' THEN ['supported|' || text] WHEN turn % 4 = 1 AND trim(text) <> '' THEN ['unverifiable|' || text] END AS claims FROM conversations")
def claim_reply(spark, sf_dir):
    """Replies as JSON: one good claim, one of no text, one of a status that there isn't; some without a claim, some not JSON."""
    claim = lambda text, status: F.struct(text.alias("text"), F.lit(status).alias("status"))
    text, none = F.col("text"), F.lit("")
    some = lambda status: F.concat(F.lit("so: "), F.to_json(F.struct(F.array(claim(text, status), claim(none, "supported"), claim(text, "odd")).alias("claims"))))
    reply = F.when(F.col("turn") % 4 == 0, some("supported")).when(F.col("turn") % 4 == 1, some("unverifiable")).when(F.col("turn") % 4 == 2, F.lit('{"claims": []}')).otherwise(text)
    found = F.transform(gates.parsed_claims(reply), lambda c: F.concat_ws("|", c["status"], c["text"]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("claims"))


# answers ---------------------------------------------------------------------------------------

_ANSWERS = "SELECT conv_id * 1000 + turn AS id, text || ' [' || (1 + turn % 4) || '] and [' || (1 + conv_id % 12) || ']' || CASE WHEN turn % 3 = 0 THEN '[2][10]' ELSE '' END AS answer, CASE WHEN turn % 5 = 4 THEN 0 ELSE CAST(conv_id % 11 AS INT) END AS n FROM conversations"


@query("g6_citations", f"WITH a AS ({_ANSWERS})" + r""", c AS (SELECT id, answer, n, list_distinct(regexp_extract_all(answer, '\[(\d+)\]', 1)) AS cited, list_transform(range(1, n + 1), lambda i: CAST(i AS VARCHAR)) AS avail FROM a)
SELECT id, list_transform(list_sort(list_transform(list_filter(cited, lambda x: list_contains(avail, x)), lambda x: CAST(x AS INT))), lambda x: CAST(x AS VARCHAR)) AS cited_valid, list_transform(list_sort(list_transform(list_filter(cited, lambda x: NOT list_contains(avail, x)), lambda x: CAST(x AS INT))), lambda x: CAST(x AS VARCHAR)) AS cited_invalid,
list_transform(list_sort(list_transform(list_filter(avail, lambda x: NOT list_contains(cited, x)), lambda x: CAST(x AS INT))), lambda x: CAST(x AS VARCHAR)) AS unused, CASE WHEN n = 0 THEN NOT regexp_matches(answer, '\[\d+\]') ELSE len(list_filter(cited, lambda x: NOT list_contains(avail, x))) = 0 END AS valid FROM c""")
def citations(spark, sf_dir):
    """G6 and G11."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text || ' [' || (1 + turn % 4) || '] and [' || (1 + conv_id % 12) || ']' || CASE WHEN turn % 3 = 0 THEN '[2][10]' ELSE '' END AS answer", "CASE WHEN turn % 5 = 4 THEN 0 ELSE CAST(conv_id % 11 AS INT) END AS n")
    found = rows.select("id", gates.citations(F.col("answer"), gates.source_numbers(F.col("n"))).alias("c"), gates.citation_valid(F.col("answer"), F.col("n")).alias("valid"))
    return found.select("id", "c.cited_valid", "c.cited_invalid", "c.unused", "valid")


@query("g7_repair", rf"WITH a AS ({_ANSWERS}) SELECT id, [regexp_replace(answer, '\[(0|[4-9]|\d\d+)\]', '', 'g')] AS evidence FROM a")
def repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS id", "text || ' [' || (1 + turn % 4) || '] and [' || (1 + conv_id % 12) || ']' || CASE WHEN turn % 3 = 0 THEN '[2][10]' ELSE '' END AS answer")
    return rows.select("id", gates.repaired(F.array("answer"), F.array(*map(F.lit, ["1", "2", "3"]))).alias("evidence"))


# a model's structured answer: whole, fenced, citing what there isn't, without a field, an array, or no JSON
_RAW = """CASE turn % 6 WHEN 0 THEN '```json' || chr(10) || '{"diagnosis": ' || quoted || ', "confidence": "high", "evidence": ["a [' || (1 + conv_id % 3) || ']"]}' || chr(10) || '```' WHEN 1 THEN '{"diagnosis": ' || quoted || ', "confidence": "low", "evidence": ["b [' || (1 + conv_id % 4) || ']", "c"]}'
 WHEN 2 THEN '{"diagnosis": ' || quoted || '}' WHEN 3 THEN '[' || quoted || ', 2]' WHEN 4 THEN text ELSE 'first ```{"diagnosis": ' || quoted || ', "confidence": "low", "evidence": []}```' END"""


@query("g8_answers", f"""WITH q AS (SELECT conv_id, turn, text, CAST(to_json(text) AS VARCHAR) AS quoted FROM conversations), r AS (SELECT conv_id, turn, {_RAW} AS raw FROM q),
b AS (SELECT conv_id, turn, CASE WHEN contains(raw, '```') THEN regexp_extract(raw, '```(?:json)?\\s*(.*?)\\s*(?:```|$)', 1, 's') ELSE raw END AS body FROM r),
j AS (SELECT conv_id, turn, body, CASE WHEN json_valid(body) AND starts_with(body, '{{') THEN body END AS j FROM b)
SELECT conv_id, turn, j IS NOT NULL AND coalesce(json_exists(j, '$.diagnosis') AND json_exists(j, '$.confidence') AND json_exists(j, '$.evidence') AND len(list_filter(regexp_extract_all(CAST(json_extract(j, '$.evidence') AS VARCHAR), '\\[(\\d+)\\]', 1), lambda x: x NOT IN ('1', '2'))) = 0, false) AS good FROM j""")
def answers(spark, sf_dir):
    listed = F.to_json(F.array("text"))
    quoted = F.regexp_replace(listed, r"(?s)^\[|\]$", "")
    rows = table(spark, sf_dir, "conversations").withColumn("quoted", quoted)
    return rows.select("conv_id", "turn", gates.parsed_answer(F.expr(_RAW), F.array(F.lit("1"), F.lit("2")))["good"].alias("good"))


_EXPECTED = "CASE doc_id % 5 WHEN 0 THEN substr(text, 3, 12) WHEN 1 THEN replace(substr(text, 5, 20), ' ', '  ') WHEN 2 THEN '  ' WHEN 3 THEN 'no such words' ELSE substr(text, 2, 9) END"


@query("e17_final_answer", rf"WITH e AS (SELECT doc_id, substr(text, 1, 200) AS text, {_EXPECTED} AS expected FROM documents) SELECT doc_id, trim(expected) <> '' AND contains(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g'), regexp_replace(expected, '[ \t\n\x0B\f\r]+', '', 'g')) AS ok FROM e")
def final_answer(spark, sf_dir):
    """The text as an answer, plain or as JSON in a fence, whose place of the expected words is known."""
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_EXPECTED).alias("expected"), F.substring("text", 1, 200).alias("text"))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("diagnosis"), F.array(F.lit("e [1]")).alias("evidence"))), F.lit("\n```"))
    answer = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(fenced)
    return rows.select("doc_id", E.final_answer_ok(answer, F.col("expected")).alias("ok"))


# decisions -------------------------------------------------------------------------------------


@query("g18_early_policy", "SELECT doc_id, ['sufficient', 'needs_decomposition', 'insufficient'][1 + doc_id % 3] AS grade, toxic = 1 AS unsupported, CASE WHEN doc_id % 3 = 0 THEN 'ACCEPT' WHEN doc_id % 3 = 1 THEN 'DECOMPOSE' WHEN toxic = 1 THEN 'ABSTAIN' ELSE 'RETRIEVE' END AS action FROM labels")
def early_policy(spark, sf_dir):
    grade = F.element_at(F.array(*map(F.lit, ("sufficient", "needs_decomposition", "insufficient"))), (1 + F.col("doc_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"), (F.col("toxic") == 1).alias("unsupported"))
    return rows.withColumn("action", gates.early_decision(F.col("grade"), F.col("unsupported")))


_GRADED = f"SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 0 THEN q.q || ' ' || text ELSE text END AS q, turn % 2 = 0 AS rel, conv_id % 3 <> 0 AS shares, conv_id % 7 = 0 AS empty FROM conversations JOIN q_ q ON q.id = 1 + (conv_id + turn) % 18"


@query("g15_rule_grade", f"WITH {dealt_sql()}, r AS ({_GRADED}) SELECT id, CASE WHEN empty THEN 'insufficient' WHEN regexp_matches(q, '(?i){'|'.join(X.OUT_OF_DOMAIN)}') OR (rel AND NOT shares) THEN 'unsupported' WHEN rel THEN 'sufficient' ELSE 'insufficient' END AS grade FROM r")
def rule_grade(spark, sf_dir):
    cases = literal(spark, "id, q", QUESTIONS)
    rows = table(spark, sf_dir, "conversations").join(F.broadcast(cases.withColumnRenamed("id", "case")), F.col("case") == 1 + (F.col("conv_id") + F.col("turn")) % 18)
    q = F.when(F.col("turn") % 3 == 0, F.concat_ws(" ", "q", "text")).otherwise(F.col("text"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), gates.rule_grade(F.col("turn") % 2 == 0, F.col("conv_id") % 3 != 0, q, F.col("conv_id") % 7 == 0).alias("grade"))


@query("g16_completeness", "WITH h AS (SELECT user_id AS query_id, value / 40 AS score, event_type <> 'signup' AS required FROM events) SELECT query_id, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0 END), 6) AS completeness, round(avg(CASE WHEN score >= 0.05 THEN 1.0 ELSE 0 END), 6) AS lenient FROM h WHERE required GROUP BY query_id")
def completeness(spark, sf_dir):
    hops = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("hop"), (F.col("value") / 40).alias("evidence_score"), (F.col("event_type") != "signup").alias("required"))
    found = gates.completeness(hops).join(gates.completeness(hops, True).withColumnRenamed("completeness", "lenient"), "query_id")
    return found.select("query_id", F.round("completeness", 6).alias("completeness"), F.round("lenient", 6).alias("lenient"))


@query("a7_state_json", """SELECT event_id, '{"query_id":' || event_id || ',"decision":"' || CASE WHEN event_type = 'error' THEN 'ABSTAIN' ELSE 'ACCEPT' END || '","route":["RETRIEVE","' || upper(event_type) || '"]}' AS state FROM events""")
def state_json(spark, sf_dir):
    decision = F.when(F.col("event_type") == "error", "ABSTAIN").otherwise("ACCEPT")
    state = F.struct(F.col("event_id").alias("query_id"), decision.alias("decision"), F.array(F.lit("RETRIEVE"), F.upper("event_type")).alias("route"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(state).alias("state"))


# sources ---------------------------------------------------------------------------------------

_PATHS = "CASE doc_id % 3 WHEN 0 THEN 'd' || doc_id || '.pdf' WHEN 1 THEN lang || '/d' || doc_id || '.md' ELSE lang || '/x/d' || doc_id || '.txt' END"


@query("s6_domain", f"SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'general' END AS domain FROM (SELECT {_PATHS} AS path FROM documents)")
def domain(spark, sf_dir):
    from ..sources.files import domain_of

    return documents(spark, sf_dir).select(F.expr(_PATHS).alias("path")).select("path", domain_of(F.col("path")).alias("domain"))


_HINTS = "CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 20) || '证据未提及该年会' WHEN 1 THEN '证据充分' || substr(text, 1, 20) WHEN 2 THEN '文档中不存在' ELSE substr(text, 1, 40) END"


@query("f8_hints", f"SELECT doc_id, regexp_matches(reason, '未提及|未找到|不存在|没有提及|无相关') AS hint FROM (SELECT doc_id, {_HINTS} AS reason FROM documents)")
def hints(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.hints_unsupported(F.expr(_HINTS)).alias("hint"))


@query("k9_parent_link", f"WITH {CHUNKS}, s AS (SELECT chunk_id, 'd' || doc_id || '_l' || (pos - pos % 5) AS parent_id, text FROM chunks WHERE pos % 5 <> 0), p AS (SELECT chunk_id AS parent_id, text AS content, substr(text, 1, 20) AS heading FROM chunks WHERE pos % 5 = 0 AND doc_id % 7 <> 0) SELECT chunk_id, md5(text) AS text, parent_id, md5(content) AS parent_content, substr(content, 1, 100) AS parent_summary, heading AS section_title FROM s LEFT JOIN p USING (parent_id)")
def parent_link(spark, sf_dir):
    source = chunks(spark, sf_dir)
    small = source.where("pos % 5 <> 0").select("chunk_id", F.concat(F.lit("d"), "doc_id", F.lit("_l"), F.col("pos") - F.col("pos") % 5).alias("parent_id"), "text")
    parent = source.where("pos % 5 = 0 and doc_id % 7 <> 0").select("chunk_id", "text", F.substring("text", 1, 20).alias("heading"))
    return chunking.linked(small, parent).withColumns({"text": F.md5("text"), "parent_content": F.md5("parent_content")})


def _described(spark, sf_dir):
    """Customers as described collections: tags are market segment and nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), "c_nationkey")).alias("tags"))


@query("r16_tags", "WITH k AS (SELECT [lower(c_mktsegment), 'n' || c_nationkey] AS tags FROM customer) SELECT list_sort(list_distinct(flatten(list(tags)))) AS tags FROM k")
def tags(spark, sf_dir):
    from ..sources.collections import all_tags

    return all_tags(_described(spark, sf_dir))


_ASKED = "vec_id % 25 = 0"


@query("r17_tag_filter", f"WITH {VECTORS}, k AS (SELECT c_custkey % 10 AS domain FROM customer WHERE lower(c_mktsegment) = 'machinery' AND c_nationkey IN (3, 7)), a AS (SELECT vec_id AS query_id, embedding AS query FROM vectors WHERE {_ASKED}), s AS (SELECT query_id, vec_id, list_inner_product(embedding, query) AS score FROM vectors, a WHERE vec_id <> query_id AND domain IN (SELECT domain FROM k)) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def tag_filter(spark, sf_dir):
    """Search in the vectors of the collections that have the asked tags only."""
    from ..operators import vectors as V
    from ..sources.collections import with_tags

    tagged = with_tags(_described(spark, sf_dir).where(F.array_contains("tags", "machinery")), ["n3", "n7"])
    rows = vectors(spark, sf_dir)
    inside = rows.join(tagged.select((F.col("name") % 10).cast("int").alias("domain")).distinct(), "domain", "left_semi")
    asked = rows.where(_ASKED).select(F.col("vec_id").alias("query_id"), "embedding")
    return V.search(inside, asked, 5).withColumn("score", F.round("score", 6))


# records of evaluations ------------------------------------------------------------------------


@query("e14_rescue", "WITH p AS (SELECT event_type IN ('view', 'click') AS before, value > 10 AS after_, user_id % 2 = 0 AS pool_before, user_id % 3 <> 0 AS pool_after FROM events) SELECT CAST(count(*) FILTER (NOT before AND after_) AS BIGINT) AS rescue, count(*) FILTER (before AND NOT after_) AS harm, count(*) FILTER (NOT before AND after_) - count(*) FILTER (before AND NOT after_) AS net_utility, count(*) FILTER (NOT pool_before AND pool_after) AS candidate_rescue, count(*) FILTER (pool_after AND after_) AS rerank_rescue, count(*) FILTER (pool_after AND NOT after_) AS rerank_failure FROM p")
def rescue(spark, sf_dir):
    return E.rescue(table(spark, sf_dir, "events").select(F.col("event_type").isin("view", "click").alias("before"), (F.col("value") > 10).alias("after"), (F.col("user_id") % 2 == 0).alias("pool_before"), (F.col("user_id") % 3 != 0).alias("pool_after")))


_CASES = """'b' || (o_orderkey // 3) AS id, CASE WHEN o_orderkey % 11 = 0 THEN '2026-1-2' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS discovered, CASE WHEN o_custkey % 13 = 0 THEN '' ELSE o_orderpriority END AS problem, 'e' AS expected_behavior, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'r' END AS root_cause, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'f' END AS fix, 'v' AS verification, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'odd' END AS status"""


@query("e22_audit", f"WITH t AS (SELECT {_CASES} FROM orders), v AS (" + " UNION ALL ".join([f"SELECT id, 'missing {c}' AS violation FROM t WHERE coalesce({c}, '') = ''" for c in E.REQUIRED] + ["SELECT id, 'status' FROM t WHERE status <> '' AND status NOT IN ('open', 'investigating', 'fixing', 'verifying', 'closed')", r"SELECT id, 'discovered' FROM t WHERE discovered <> '' AND NOT regexp_matches(discovered, '^\d{4}-\d{2}-\d{2}$')", "SELECT id, 'repeated id' FROM t WHERE id IN (SELECT id FROM t GROUP BY id HAVING count(*) > 1)"] + [f"SELECT id, 'closed without {c}' FROM t WHERE status = 'closed' AND coalesce({c}, '') = ''" for c in ("root_cause", "fix", "verification")]) + ") SELECT * FROM v")
def audit(spark, sf_dir):
    cases = _CASES.replace("o_orderkey // 3", "o_orderkey div 3").replace("strftime(o_orderdate, '%Y-%m-%d')", "date_format(o_orderdate, 'yyyy-MM-dd')")
    return E.audit(table(spark, sf_dir, "orders").selectExpr(*split_columns(cases)))


_BY = "SELECT event_type AS metric, avg(value) AS value FROM events WHERE user_id % 2 = {0} GROUP BY 1"
_TOLERANCE = {"view": 0.5, "click": 0.0, "error": 0.1, "purchase": 0.0, "signup": 2.0}


@query("e23_regression", f"WITH n AS ({_BY.format(0)}), b AS ({_BY.format(1)}) SELECT metric, round(n.value - b.value, 6) AS delta, n.value - b.value >= -(CASE metric WHEN 'view' THEN 0.5 WHEN 'error' THEN 0.1 WHEN 'signup' THEN 2.0 ELSE 0 END) - 1e-12 AS ok FROM n JOIN b USING (metric)")
def regression(spark, sf_dir):
    means = lambda k: table(spark, sf_dir, "events").where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return E.regressions(means(0), means(1), _TOLERANCE)


@query("e24_parity", "WITH a AS (SELECT conv_id AS query_id, role AS route, substr(text, 1, 2) AS answer FROM conversations WHERE turn = 0), b AS (SELECT conv_id AS query_id, CASE WHEN conv_id % 3 = 0 THEN 'user' ELSE role END AS route, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE substr(text, 1, 2) END AS answer FROM conversations WHERE turn = 2) SELECT count(*) AS n, sum(CAST(a.route IS NOT DISTINCT FROM b.route AS INT)) AS route, sum(CAST(a.answer IS NOT DISTINCT FROM b.answer AS INT)) AS answer FROM a JOIN b USING (query_id)")
def parity(spark, sf_dir):
    """The first and the third turn of each conversation as two runs."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("route"), F.substring("text", 1, 2).alias("answer"), "turn")
    other = rows.where("turn = 2").withColumn("route", F.when(F.col("query_id") % 3 == 0, "user").otherwise(F.col("route"))).withColumn("answer", F.when(F.col("query_id") % 5 != 0, F.col("answer")))
    return E.parity(rows.where("turn = 0"), other, ["route", "answer"])
