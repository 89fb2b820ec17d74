"""Gates on retrieval and answers: relevance, entity overlap, domain, citations, claims, and the decision rules of the agent.

Hits are (query_id, rank, text, vector_score, ...), ranks from 1; questions are (query_id, question).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, hints_unsupported, is_comparison, is_mostly_english, is_multi_part, is_out_of_domain, is_time_sensitive

SUPPORTED, PARTIAL = 0.5, 0.05

#: CJK words that tell no topic apart (fixed values).
GENERIC = [
    "如何", "什么", "哪些", "多少", "为什么", "怎样", "是否", "包括", "主要", "用于", "系统", "方法",
    "技术", "模型", "数据", "治疗", "诊断", "检查", "流程", "步骤", "作用", "影响", "分析", "应用",
    "方案", "相关", "特点", "优势", "区别", "对比", "临床", "影像", "医学", "患者", "疾病", "功能",
    "评估", "结果", "风险", "标准", "心血管", "长期", "不同", "之间", "以及", "进行", "可以", "需要",
    "通过", "患者的", "问题", "情况", "目的", "对象", "方式", "方面", "内容", "类型", "指标",
]
STOP_BIGRAMS = [
    "一个", "多少", "什么", "如何", "哪些", "为什么", "怎样", "是否", "的是", "用于", "中的", "在肺",
    "栓塞",
]


def grams(t: Column, n: int) -> Column:
    """The distinct n-grams of characters."""
    found = F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(F.length(t) >= n, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def overlap(question: Column, text: Column) -> Column:
    """The share of the question's n-grams that the first 500 characters have; null if it has none."""
    english = is_mostly_english(question)
    head = F.substring(text, 1, 500)
    three, two = grams(F.lower(question), 3), grams(question, 2)
    own = F.when(english, three).otherwise(two)
    other = F.when(english, grams(F.lower(head), 3)).otherwise(grams(head, 2))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, other)) / F.size(own))


def relevance(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, top1_score, avg_score, overlap, bm25_support, combined, is_relevant, reason); questions without hits aren't relevant."""
    met = hits.join(questions, "query_id").select("query_id", "rank", "vector_score", "sources", overlap(F.col("question"), F.col("text")).alias("share"))
    sums = met.groupBy("query_id").agg(
        F.min_by("vector_score", "rank").alias("top1_score"),
        F.avg("vector_score").alias("avg_score"),
        F.coalesce(F.avg("share"), F.lit(0.0)).alias("overlap"),
        F.max((F.col("rank") <= 3) & F.col("sources").contains("bm25")).alias("bm25_support"),
    )
    rows = questions.join(sums, "query_id", "left").fillna(0.0, ["top1_score", "avg_score", "overlap"]).withColumn("empty", F.col("bm25_support").isNull()).fillna(False, ["bm25_support"])
    needed = F.when(is_mostly_english(F.col("question")), 0.01).otherwise(0.03)
    combined = F.col("top1_score") * 0.6 + F.col("overlap") * 0.4
    reason = (
        F.when(F.col("empty"), "empty")
        .when((F.col("top1_score") < 0.10) & (F.col("overlap") < 0.02), "too_low")
        .when((F.col("overlap") < needed) & ~F.col("bm25_support"), "no_overlap")
        .when(combined + F.when(F.col("bm25_support"), 0.05).otherwise(0.0) >= 0.25, "combined")
        .when((F.col("top1_score") > 0.60) & (F.col("overlap") > 0.05), "semantic")
        .otherwise("below")
    )
    return rows.select("query_id", "question", "top1_score", "avg_score", "overlap", "bm25_support", combined.alias("combined"), reason.alias("reason")).withColumn("is_relevant", F.col("reason").isin("combined", "semantic"))


def cjk_grams(q: Column, sizes: tuple[int, ...]) -> Column:
    found = F.concat(*(grams(q, n) for n in sizes))
    return F.filter(found, lambda g: g.rlike(f"^[{CJK}]+$") & ~g.isin(*GENERIC))


def entities(q: Column) -> Column:
    """ASCII words of three characters or more, and CJK pieces of two to four that tell topics apart."""
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(q), F.lit(r"[a-z][a-z0-9\-]{2,}"), 0), cjk_grams(q, (4, 3, 2))))


def evidence_text(hits: DataFrame, first: int, chars: int) -> DataFrame:
    """(query_id, evidence): the beginnings of the first hits, in lower case."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, chars).alias("t")))), lambda x: x["t"])
    return hits.where(F.col("rank") <= first).groupBy("query_id").agg(F.lower(F.array_join(parts, " ")).alias("evidence"))


def entity_overlap(questions: DataFrame, hits: DataFrame, first: int, without: float) -> DataFrame:
    """(query_id, entity_overlap): the share of the question's entities in its first hits; ``without`` if it has none, 0 without hits."""
    rows = questions.join(evidence_text(hits, first, 800), "query_id", "left").withColumn("entities", entities(F.col("question")))
    found = F.size(F.filter("entities", lambda e: F.col("evidence").contains(e)))
    share = F.when(F.col("evidence").isNull(), 0.0).when(F.size("entities") == 0, without).otherwise(found / F.greatest(F.size("entities"), F.lit(1)))
    return rows.select("query_id", share.alias("entity_overlap"))


def has_shared_token(q: Column, t: Column) -> Column:
    """A common ASCII word, or two common pairs of characters."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9\-]{2,}"), 0)
    pairs = F.array_except(grams(F.lower(q), 2), F.array(*map(F.lit, STOP_BIGRAMS)))
    return F.arrays_overlap(words(q), words(t)) | (F.size(F.array_intersect(pairs, grams(F.lower(t), 2))) >= 2)


def topically_related(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, related): in the domain, and an ASCII word or a CJK piece of three or four is in the first five hits."""
    rows = questions.join(evidence_text(hits, 5, 600), "query_id", "left")
    known = F.concat(F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z][a-z0-9\-]{2,}"), 0), cjk_grams(F.col("question"), (4, 3)))
    return rows.select("query_id", (~is_out_of_domain(F.col("question")) & F.coalesce(F.exists(known, lambda e: F.col("evidence").contains(e)), F.lit(False))).alias("related"))


def domain_gate(verdict: DataFrame, overlaps: DataFrame) -> DataFrame:
    """The relevance verdict after the gate: out of domain by rule with little overlap, or hardly any entity in the evidence."""
    rows = verdict.join(overlaps, "query_id", "left")
    blocked = F.col("is_relevant") & ((is_out_of_domain(F.col("question")) & (F.col("overlap") < 0.15)) | (F.coalesce("entity_overlap", F.lit(0.0)) < 0.08))
    return rows.withColumn("is_refusal", blocked).withColumn("is_relevant", F.col("is_relevant") & ~blocked)


# answers ---------------------------------------------------------------------------------------


def citations(answer: Column, available: Column) -> Column:
    """Which of the sources "1" to "n" an answer cites, which it makes up, and which it leaves out."""
    numeric = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x.cast("int").alias("n"), x.alias("s")))), lambda x: x["s"])
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1))
    good, bad, unused = F.array_intersect(cited, available), F.array_except(cited, available), F.array_except(available, cited)
    return F.struct(numeric(good).alias("cited_valid"), numeric(bad).alias("cited_invalid"), numeric(unused).alias("unused"), (F.size(bad) > 0).alias("has_invalid_citations"), (F.size(unused) > 0).alias("has_unused_sources"))


def source_numbers(n: Column) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))


def repaired(evidence: Column, available: Column) -> Column:
    """Evidence strings without citations of sources that don't exist."""
    bad = lambda s: F.array_except(F.array_distinct(F.regexp_extract_all(s, F.lit(r"\[\d+\]"), 0)), F.transform(available, lambda x: F.concat(F.lit("["), x, F.lit("]"))))
    return F.transform(evidence, lambda s: F.aggregate(bad(s), s, lambda acc, b: F.replace(acc, b, F.lit(""))))


ANSWER = "diagnosis string, confidence string, evidence array<string>, suggestion string, sources array<string>, uncertainty string"


def parsed_answer(raw: Column, available: Column) -> Column:
    """A structured answer and whether it is good: an object with its three fields whose citations all exist."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*(?:```|$)", 1)
    body = F.regexp_replace(F.trim(F.when(raw.contains("```"), fenced).otherwise(raw)), r"^json\s*", "")
    data = F.from_json(body, ANSWER)
    cited = F.flatten(F.transform(data["evidence"], lambda s: F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), 1)))
    whole = data["diagnosis"].isNotNull() & data["confidence"].isNotNull() & data["evidence"].isNotNull()
    return F.struct(data.alias("data"), F.coalesce(whole & body.startswith("{") & (F.size(F.array_except(cited, available)) == 0), F.lit(False)).alias("good"))


def claims(answers: DataFrame) -> DataFrame:
    """(query_id, n, claim, status) of the sentences of each answer against its evidence, by shared characters.

    ``answers``: (query_id, answer, evidence). Refusals and failures have no claims.
    """
    good = F.coalesce(F.col("answer"), F.lit("")) != ""
    rows = answers.where(good & ~F.col("answer").contains("知识库中未找到") & ~F.col("answer").startswith("[OPERATIONAL_ERROR]"))
    pieces = F.filter(F.transform(F.split("answer", "[。！？；\\n]+", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) >= 6)
    found = rows.select("query_id", "evidence", F.posexplode(pieces).alias("n", "claim"))
    letters = F.array_distinct(F.split("claim", ""))
    known = F.array_distinct(F.split("evidence", ""))
    share = F.size(F.array_intersect(letters, known)) / F.size(letters)
    markup = F.col("claim").rlike(r"^[*>\-#\d.\[\]（）()\s]+$") | F.substring("claim", 1, 4).contains("**")
    return found.select("query_id", "n", "claim", F.when(markup, "unverifiable").when(share >= 0.6, "supported").otherwise("unsupported").alias("status"))


def parsed_claims(reply: Column) -> Column:
    """Claims of a model's reply with a known status; null if there are none."""
    data = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "claims array<struct<text:string,status:string>>")
    good = F.filter(data["claims"], lambda c: (F.trim(c["text"]) != "") & F.trim(c["status"]).isin("supported", "unsupported", "unverifiable"))
    return F.when(F.size(good) > 0, good)


def citation_valid(answer: Column, n_sources: Column) -> Column:
    return F.when(n_sources == 0, ~answer.rlike(r"\[\d+\]")).otherwise(~citations(answer, source_numbers(n_sources))["has_invalid_citations"])


def prompt_context(hits: DataFrame) -> DataFrame:
    """(query_id, context, source_map): the hits as numbered references, a parent's text added where it is much longer."""
    head = F.concat(F.lit("["), F.col("rank"), F.lit("] 文件: "), F.coalesce("filename", F.lit("未知")), F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" | 章节: "), F.col("section_title"))).otherwise(""))
    longer = F.length("parent_content") > F.length("text") * 1.5
    body = F.when(F.coalesce(longer, F.lit(False)), F.concat("text", F.lit("\n\n> 📖 **完整上下文（本节）**\n"), "parent_content")).otherwise(F.col("text"))
    part = F.struct("rank", F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("part"))
    source = F.struct(F.col("rank").cast("string").alias("key"), F.struct("filename", F.col("section_title").alias("section"), F.round("score", 3).alias("score"), F.substring("text", 1, 100).alias("text_preview")).alias("value"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "\n")
    return hits.groupBy("query_id").agg(joined.alias("context"), F.map_from_entries(F.collect_list(source)).alias("source_map"))


# decisions -------------------------------------------------------------------------------------


def support_status(score: Column) -> Column:
    return F.when(score >= SUPPORTED, "SUPPORTED").when(score >= PARTIAL, "PARTIAL").otherwise("MISSING")


def completeness(hops: DataFrame, partial_counts: bool = False) -> DataFrame:
    """(query_id, completeness): the supported share of required hops; ``partial_counts``: partial ones count too."""
    good = F.col("status") != "MISSING" if partial_counts else F.col("status") == "SUPPORTED"
    required = hops.where("required").withColumn("status", support_status(F.col("evidence_score")))
    return required.groupBy("query_id").agg(F.avg(good.cast("double")).alias("completeness"))


def signal_verdict(s: DataFrame, max_iterations: int = 2) -> DataFrame:
    """Adds ``verdict`` by the cheap signals alone, in their order of precedence.

    State: question, top1, comp, lexical, n_hops, missing_hop (boolean), decomposed, budget, iteration.
    """
    q, planless = F.col("question"), F.col("n_hops") == 0
    fresh = planless & ~F.col("decomposed")
    ood = is_out_of_domain(q)
    verdict = (
        F.when(is_multi_part(q) & fresh, "DECOMPOSE")
        .when(is_comparison(q) & fresh, "UNCERTAIN")
        .when(is_time_sensitive(q), "UNCERTAIN")
        .when(~planless & (F.col("comp") >= 1.0), "ACCEPT")
        .when(planless & (F.col("top1") >= SUPPORTED), F.when(ood | (F.col("lexical") <= 0), "UNCERTAIN").otherwise("ACCEPT"))
        .when(planless & (F.col("top1") < PARTIAL), F.when(ood, "ABSTAIN").when((F.col("budget") > 0) & (F.col("iteration") < max_iterations), "RETRIEVE").otherwise("ABSTAIN"))
        .when(~planless, F.when(~F.col("missing_hop"), "UNCERTAIN").when(F.col("budget") > 0, "RETRIEVE").otherwise("ABSTAIN"))
        .otherwise("UNCERTAIN")
    )
    return s.withColumn("verdict", verdict)


def rule_grade(is_relevant: Column, shares: Column, question: Column, empty: Column) -> Column:
    """The grader without a model: insufficient, unsupported or sufficient."""
    return F.when(empty, "insufficient").when(is_out_of_domain(question), "unsupported").when(is_relevant & ~shares, "unsupported").when(is_relevant, "sufficient").otherwise("insufficient")


def decided(s: DataFrame, max_iterations: int = 2) -> DataFrame:
    """Adds ``decision``: the cheap verdict, or for uncertain ones the grader's, or the rule of last resort.

    State: as ``signal_verdict``, and grade, grade_reason.
    """
    rows = signal_verdict(s, max_iterations)
    several = is_multi_part(F.col("question")) | is_comparison(F.col("question"))
    more = (F.col("budget") > 0) & (F.col("iteration") < max_iterations)
    unsupported = (F.col("grade") == "unsupported") | ((F.col("grade") == "insufficient") & hints_unsupported(F.col("grade_reason")))
    by_grade = (
        F.when(F.col("grade") == "sufficient", "ACCEPT")
        .when(F.col("grade") == "needs_decomposition", "DECOMPOSE")
        .when(unsupported & ~(several & (F.col("n_hops") == 0)), F.when(more, "RETRIEVE").otherwise("ABSTAIN"))
        .when(several & (F.col("n_hops") == 0) & ~F.col("decomposed"), "DECOMPOSE")
        .otherwise(F.when(more, "RETRIEVE").otherwise("ABSTAIN"))
    )
    return rows.withColumn("decision", F.when(F.col("verdict") != "UNCERTAIN", F.col("verdict")).otherwise(by_grade)).withColumn("mode", F.when(F.col("verdict") != "UNCERTAIN", "cheap_signal").otherwise("grader"))


def early_decision(grade: Column, unsupported: Column) -> Column:
    """The first policies' map from grades to actions; ``unsupported`` abstains."""
    return F.when(grade == "sufficient", "ACCEPT").when(grade == "needs_decomposition", "DECOMPOSE").when(unsupported, "ABSTAIN").otherwise("RETRIEVE")


def cache_key(question: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", question, *parts), 256)


def plan(question: Column) -> Column:
    """A deterministic plan: the parts between question marks."""
    return F.filter(F.transform(F.split(F.replace(question, F.lit("?"), F.lit("？")), "？", -1), lambda p: F.trim(p)), lambda p: p != "")
