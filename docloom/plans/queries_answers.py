"""Queries of prompts, refusals, gold chunks, exit criteria and golden questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E, prompts as P
from . import queries_eval as Q
from .queries_text import _Q, _questions
from .registry import query
from .tables import chunks, literal, questions, table, with_chunks



def sql(text: str) -> str:
    """A fixed text as an SQL expression."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_TOP = f"{Q._HITS}, h AS (SELECT query_id, rank, filename, text FROM hits JOIN chunks USING (filename) WHERE chunk_id = id)"


def _hits(spark, sf_dir):
    """Hits with the section that a prompt shows: every other file has one."""
    found = with_chunks(Q._hits(spark, sf_dir), chunks(spark, sf_dir).select("chunk_id", "text", "doc_id"))
    return found.withColumn("section_title", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 10)).otherwise("")).withColumn("parent_content", F.lit(None).cast("string"))


_TAG = "'[' || rank || '] 文件: ' || filename || CASE WHEN CAST(substr(filename, 2) AS BIGINT) % 2 = 0 AND substr(text, 1, 10) <> '' THEN ' | 章节: ' || substr(text, 1, 10) ELSE '' END || chr(10) || text || chr(10)"


def _prompt_sql(before: str, empty: str, asked: str, after: str, most: int) -> str:
    return f"{_TOP}, c AS (SELECT query_id, string_agg({_TAG}, chr(10) ORDER BY rank) AS context FROM h WHERE rank <= {most} GROUP BY query_id) SELECT query_id, md5({sql(before)} || coalesce(context, {sql(empty)}) || {sql(asked)} || question || {sql(after)}) AS content FROM questions LEFT JOIN c USING (query_id)"


def _content(df):
    return df.select("query_id", F.md5(F.element_at("messages", 2)["content"]).alias("content"))


@query("g12_rag_prompt", _prompt_sql(P.RAG_BEFORE, P.RAG_EMPTY, P.RAG_ASKED, P.RAG_AFTER, 10))
def rag_prompt(spark, sf_dir):
    return _content(P.rag_prompt(questions(spark, sf_dir), _hits(spark, sf_dir)))


@query("g12_quick_prompt", _prompt_sql(P.QUICK_BEFORE, P.QUICK_EMPTY, P.QUICK_ASKED, P.QUICK_AFTER, 2))
def quick_prompt(spark, sf_dir):
    return _content(P.quick_prompt(questions(spark, sf_dir), _hits(spark, sf_dir)))


# every conversation turn as a prompt: with either heading, the question on the heading's line or below it, or bare
_MADE = "CASE turn % 4 WHEN 0 THEN 'docs' || chr(10) || '## 用户问题' || chr(10) || text || chr(10) || chr(10) || '## 回答' || chr(10) WHEN 1 THEN '## 问题' || chr(10) || text || chr(10) || '## 快速回答' WHEN 2 THEN text ELSE 'docs' || chr(10) || '## 用户问题 ' || text END"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("g13_question_of", f"WITH m AS (SELECT conv_id, turn, {_MADE} AS content FROM conversations) SELECT conv_id, turn, CASE WHEN contains(content, '## 用户问题') THEN {_STRIP.format("string_split(string_split(content, '## 用户问题')[-1], '##')[1]")} WHEN contains(content, '## 问题') THEN {_STRIP.format("string_split(string_split(content, '## 问题')[-1], '##')[1]")} WHEN length(content) < 500 THEN substr(content, 1, 200) ELSE 'an earlier one' END AS question FROM m")
def question_of(spark, sf_dir):
    """The question back out of messages; of a long last message without heading the one before counts."""
    part = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(part("system", F.lit("## 用户问题 no")), part("user", F.lit("an earlier one")), part("assistant", F.lit("x")), part("user", F.expr(_MADE)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.question_of(messages).alias("question"))


@query("g13_question_of_prompt", f"WITH m AS (SELECT conv_id, turn, string_split({_MADE}, chr(10)) AS l FROM conversations), p AS (SELECT conv_id, turn, l, list_position(list_transform(l, lambda s: starts_with(s, '## 用户问题')), true) AS n FROM m) SELECT conv_id, turn, CASE WHEN coalesce(n, 0) = 0 THEN '' WHEN {_STRIP.format("replace(l[n], '## 用户问题', '')")} <> '' THEN {_STRIP.format("replace(l[n], '## 用户问题', '')")} ELSE coalesce({_STRIP.format('l[n + 1]')}, '') END AS question FROM p")
def question_of_prompt(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.question_of_prompt(F.expr(_MADE)).alias("question"))


_WHY = "CASE WHEN item_id % 3 = 0 THEN 'score ' || item_id ELSE '' END"
_LINE = " || chr(10) || "


def _text_sql(*parts: str) -> str:
    return _LINE.join(parts)


_REFUSAL = _text_sql(sql(P.CONCLUSION), f"{sql(P.NOT_FOUND[0])} || text || {sql(P.NOT_FOUND[1])}", "''", sql(P.GROUNDS), sql(P.NONE), "''", sql(P.SOURCES), sql(P.NONE), "''", sql(P.OPEN), "'-'", "''", sql(P.NEXT), sql(P.REPHRASE))
_BECAUSE = f"CASE WHEN {_WHY} <> '' THEN chr(10) || chr(10) || {sql(P.REASON)} || {_WHY} ELSE '' END"
_ABSTAIN = _text_sql(sql(P.CONCLUSION), f"{sql(P.NOT_ENOUGH)} || text", "''", sql(P.GROUNDS), sql(P.NOT_RELATED)) + f" || {_BECAUSE} || chr(10) || " + _text_sql("''", sql(P.NEXT), *map(sql, P.TRY_AGAIN))


@query("g14_refusals", f"SELECT item_id, md5({_REFUSAL} || {_BECAUSE}) AS refusal, md5({_ABSTAIN}) AS abstention, md5(CASE WHEN item_id % 4 = 0 THEN {_REFUSAL} ELSE {_text_sql(sql(P.CONCLUSION), sql(P.COVERED), "''", sql(P.SOURCES), "'> [1] 文件: a.pdf' || CASE WHEN item_id % 2 = 1 THEN ' | 页码: ' || item_id ELSE '' END", "'> [2] 文件: b.md'", "''", sql(P.OPEN), sql(P.NO_MODEL))} END) AS without_model FROM benchmark")
def refusals(spark, sf_dir):
    """The texts of refusals and abstentions, with a reason or without, and of answers without a model."""
    text, why = F.col("text"), F.expr(_WHY)
    source = lambda name, page: F.struct(F.lit(name).alias("filename"), page.alias("page"))
    two = F.array(source("a.pdf", F.when(F.col("item_id") % 2 == 1, F.col("item_id").cast("string"))), source("b.md", F.lit("")))
    sources = F.when(F.col("item_id") % 4 == 0, F.array().cast("array<struct<filename:string,page:string>>")).otherwise(two)
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(P.refusal(text, why)).alias("refusal"), F.md5(P.abstention(text, why)).alias("abstention"), F.md5(P.without_model(text, sources)).alias("without_model"))


# gold chunks -----------------------------------------------------------------------------------

_GOLD = "CASE event_type WHEN 'view' THEN 'answerable' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'unsupported' END"
_RECORDS = f"SELECT event_id, {_GOLD} AS gold_answerability, CASE WHEN user_id % 7 <> 0 THEN 'd' || user_id ELSE '' END AS expected_doc, event_id % 3 AS n_gold, value > 5 AS expected_hit, event_id % 2 = 0 AS correct_refusal FROM events"


def _gold_records(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(1), F.col("event_id") % 3), lambda i: F.concat(F.lit("c"), i))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.expr(_GOLD).alias("gold_answerability"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("d"), "user_id")).otherwise("").alias("expected_doc"), F.when(F.col("event_id") % 3 > 0, ids).alias("gold_chunk_ids"), (F.col("value") > 5).alias("expected_hit"), (F.col("event_id") % 2 == 0).alias("correct_refusal"))


@query("e9_answerability", f"SELECT coalesce(gold_answerability, 'unlabeled') AS answerability, count(*) AS n FROM ({_RECORDS}) WHERE expected_doc <> '' GROUP BY 1")
def answerability(spark, sf_dir):
    return E.answerability(_gold_records(spark, sf_dir))


@query("e9_chunk_level", f"SELECT avg(CASE WHEN n_gold > 0 THEN CAST(expected_hit AS INT) END) AS chunk_hit_rate, count(*) FILTER (gold_answerability = 'unsupported') AS unsupported, count(*) FILTER (gold_answerability = 'unsupported' AND correct_refusal) AS refused, round(avg(CASE WHEN gold_answerability = 'unsupported' THEN CAST(correct_refusal AS INT) END), 4) AS refusal_rate FROM ({_RECORDS})")
def chunk_level(spark, sf_dir):
    return E.chunk_level(_gold_records(spark, sf_dir))


@query("e11_precision_at_k", f"{Q._HITS} SELECT k, round(avg(p), 6) AS precision FROM (SELECT k, query_id, count(DISTINCT filename) / count(*) AS p FROM hits JOIN (VALUES (1), (3), (5), (10)) AS t(k) ON rank <= k GROUP BY 1, 2) GROUP BY k")
def precision_at_k(spark, sf_dir):
    return E.precision_at_k(Q._hits(spark, sf_dir), literal(spark, "k", "(1), (3), (5), (10)")).withColumn("precision", F.round("precision", 6))


# criteria --------------------------------------------------------------------------------------


@query("e23_exit_criteria", f"""{Q._R}, d AS (SELECT date_trunc('month', ts) AS month, c.* FROM c JOIN events ON event_id = id), m AS (SELECT month, sum(CASE WHEN hit AND NOT answer_ok THEN 1 ELSE 0 END) AS harm, count(*) FILTER (type = 'unsupported_ood') AS ood, count(*) FILTER (type = 'unsupported_ood' AND abstained) AS ood_rejected, count(*) FILTER (type <> 'unsupported_ood' AND abstained) AS false_abstain, sum(CAST(unnecessary AS INT)) AS unnecessary, avg(CASE WHEN type <> 'unsupported_ood' THEN hop END) AS evidence_recall, sum(CAST(decomposition_success AS INT)) AS decomposition_success FROM d GROUP BY 1),
r AS (SELECT unnest(['harm', 'ood_reject', 'false_abstain', 'unnecessary', 'evidence_recall', 'decomposition']) AS criterion, unnest([harm = 0, ood_rejected = ood, false_abstain = 0, unnecessary = 0, evidence_recall >= 0.8, decomposition_success > 0]) AS ok FROM m) SELECT criterion, count(*) AS months, count(*) FILTER (ok) AS met FROM r GROUP BY criterion""")
def exit_criteria(spark, sf_dir):
    """The six criteria for every month of routes: how many months meet each."""
    routes = E.route_metrics(Q._routes(spark, sf_dir)).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_trunc("month", "ts").alias("month")), "id")
    ood, n = F.col("type") == "unsupported_ood", lambda c: F.sum(c.cast("int"))
    months = routes.groupBy("month").agg(
        n(F.col("hit") & ~F.col("answer_ok")).alias("harm"), n(ood).alias("ood"), n(ood & F.col("abstained")).alias("ood_rejected"), n(~ood & F.col("abstained")).alias("false_abstain"), n(F.col("unnecessary")).alias("unnecessary"),
        F.avg(F.when(~ood, F.col("hop_recall"))).alias("evidence_recall"), n(F.col("decomposition_success")).alias("decomposition_success"),
    )
    return E.exit_criteria(months).groupBy("criterion").agg(F.count("*").alias("months"), F.count_if("ok").alias("met"))


@query("e23_rule_checks", _Q + rf""", p AS (SELECT *, list_filter(string_split(replace(q, '?', '？'), '？'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g') <> '') AS parts FROM q_),
 e AS (SELECT *, regexp_extract_all(lower(coalesce(parts[1], '')), '[A-Za-z][A-Za-z0-9\-]{{2,}}') AS a, regexp_extract_all(lower(coalesce(parts[2], '')), '[A-Za-z][A-Za-z0-9\-]{{2,}}') AS b FROM p),
 s AS (SELECT id, (len(regexp_extract_all(q, '[?？]')) >= 2 AND NOT (len(parts) >= 2 AND (list_has_any(a, b) OR (length(coalesce(parts[2], '')) <= 8 AND len(b) = 0)))) OR regexp_matches(q, '区别|对比|异同') OR (regexp_matches(q, '和|与') AND regexp_matches(q, '分别|各') AND regexp_matches(q, '[A-Za-z][A-Za-z0-9\-]{{2,}}')) AS several FROM e)
SELECT id, CASE id % 3 WHEN 0 THEN 'accept' ELSE 'decompose' END AS category, CASE id % 3 WHEN 0 THEN NOT several ELSE several END AS ok FROM s WHERE id % 3 < 2""")
def rule_checks(spark, sf_dir):
    category = F.when(F.col("id") % 3 == 0, "accept").when(F.col("id") % 3 == 1, "decompose").otherwise("none")
    return E.rule_checks(_questions(spark, sf_dir).select("id", category.alias("category"), F.col("q").alias("question")))


# golden questions ------------------------------------------------------------------------------

_FILE = "CASE doc_id % 4 WHEN 0 THEN 'd' || doc_id || '.pdf' WHEN 1 THEN 'd' || doc_id WHEN 2 THEN doc_id || '.pdf' ELSE 'other.pdf' END"
_EXPECT = "CASE WHEN doc_id % 3 = 0 THEN 'x_' || doc_id || '.pdf' WHEN doc_id % 11 = 1 THEN '' ELSE 'd' || doc_id || '.pdf' END"


@query("e25_golden_hit", f"WITH g AS (SELECT doc_id, {_EXPECT} AS e, {_FILE} AS f FROM documents), b AS (SELECT *, regexp_replace(e, '\\.[^.]*$', '') AS base FROM g) SELECT doc_id, e <> '' AND (f = e OR f = base OR starts_with(f, CASE WHEN contains(base, '_') THEN regexp_replace(base, '^[^_]*_', '') ELSE base END)) AS hit FROM b")
def golden_hit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.golden_hit(F.expr(_EXPECT), F.expr(_FILE)).alias("hit"))


_WORDS = "[substr(text, 1, 4), upper(substr(text, 5, 4)), 'zzzz']"


@query("e25_golden_answer", f"WITH k AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE {_WORDS} END AS w, text FROM documents), m AS (SELECT doc_id, w, list_filter(w, lambda x: NOT contains(text, x)) AS missing_keywords FROM k) SELECT doc_id, missing_keywords, round(CASE WHEN len(w) > 0 THEN (len(w) - len(missing_keywords)) / len(w) ELSE 1 END, 2) AS keyword_hit_rate FROM m")
def golden_answer(spark, sf_dir):
    words = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.substring("text", 1, 4), X.upper(F.substring("text", 5, 4)), F.lit("zzzz")))
    return table(spark, sf_dir, "documents").select("doc_id", E.golden_answer(F.col("text"), words).alias("a")).select("doc_id", "a.*")


@query("e28_stats", "WITH e AS (SELECT CAST(ts AS DATE) AS date, value AS seconds, event_type = 'error' AS error, event_type = 'view' AS refusal FROM events) SELECT date, count(*) AS total_queries, count(*) FILTER (NOT error) AS success_count, count(*) FILTER (error) AS error_count, count(*) FILTER (refusal) AS refusal_count, round(100 * count(*) FILTER (refusal) / count(*), 2) AS refusal_rate, round(avg(seconds), 2) AS avg_response_time FROM e GROUP BY date")
def stats(spark, sf_dir):
    return E.stats_view(E.daily_stats(Q._log(spark, sf_dir)))
