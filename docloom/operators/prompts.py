"""Prompts from hits, the question back out of a prompt, and the answers that need no model.

The texts below are fixed values: readers of prompts and answers match them. A system message is the caller's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import prompt_context

# fixed values: prompt and answer texts
RAG_BEFORE = "请根据以下参考文档回答用户问题。\n## 参考文档\n"
RAG_EMPTY = "（无参考文档）"
RAG_ASKED, RAG_AFTER = "\n## 用户问题\n", "\n\n## 回答\n"
QUICK_BEFORE = "请用最简洁的方式回答下面的医学问题。\n## 参考文档\n"
QUICK_EMPTY = "（无）"
QUICK_ASKED, QUICK_AFTER = "\n\n## 问题\n", "\n\n## 快速回答\n"
UNKNOWN_FILE = "未知"
CONCLUSION, GROUNDS, SOURCES, OPEN, NEXT = "**结论：**", "**依据：**", "**引用来源：**", "**不确定信息：**", "**建议下一步：**"
NONE = "无"
NOT_FOUND = ('知识库中未找到与"', '"相关的依据。')
REPHRASE = "请尝试换一种表述方式提问，或联系管理员添加相关文档到知识库。"
REASON = "> 📊 拒答原因: "
NOT_ENOUGH = "知识库中未找到足够证据回答："
NOT_RELATED = "检索到的内容与问题相关性不足，无法给出可靠回答。"
TRY_AGAIN = ("1. 换一种表述方式提问，或补充更多细节", "2. 联系管理员确认该主题是否已在知识库中")
COVERED = "根据知识库中检索到的相关文档，该问题已有覆盖信息。"
NO_MODEL = "未配置大模型 API，当前为检索模式，无法生成 AI 推理回答。"

#: Hits of a quick prompt.
QUICK_HITS = 2
MESSAGE = "array<struct<role:string,content:string>>"


def _messages(system: str, content: Column) -> Column:
    part = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(part("system", F.lit(system)), part("user", content))


def rag_prompt(questions: DataFrame, hits: DataFrame, system: str = "") -> DataFrame:
    """(query_id, messages, source_map) of every question (query_id, question); those without hits say so. The verbose prompt is the same."""
    found = questions.join(prompt_context(hits), "query_id", "left")
    content = F.concat(F.lit(RAG_BEFORE), F.coalesce("context", F.lit(RAG_EMPTY)), F.lit(RAG_ASKED), "question", F.lit(RAG_AFTER))
    return found.select("query_id", _messages(system, content).alias("messages"), "source_map")


def quick_prompt(questions: DataFrame, hits: DataFrame, system: str = "") -> DataFrame:
    """As ``rag_prompt``, of the first two hits and without parents' texts."""
    few = hits.where(F.col("rank") <= QUICK_HITS)
    head = F.concat(F.lit("["), F.col("rank"), F.lit("] 文件: "), F.coalesce("filename", F.lit(UNKNOWN_FILE)), F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(" | 章节: "), F.col("section_title"))).otherwise(""))
    part = F.struct("rank", F.concat(head, F.lit("\n"), "text", F.lit("\n")).alias("part"))
    source = F.struct(F.col("rank").cast("string").alias("key"), F.struct(F.coalesce("filename", F.lit("")).alias("filename"), F.substring("text", 1, 100).alias("text_preview")).alias("value"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "\n")
    contexts = few.groupBy("query_id").agg(joined.alias("context"), F.map_from_entries(F.collect_list(source)).alias("source_map"))
    content = F.concat(F.lit(QUICK_BEFORE), F.coalesce("context", F.lit(QUICK_EMPTY)), F.lit(QUICK_ASKED), "question", F.lit(QUICK_AFTER))
    return questions.join(contexts, "query_id", "left").select("query_id", _messages(system, content).alias("messages"), "source_map")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def question_of_prompt(prompt: Column) -> Column:
    """What follows the question's heading on its line, else the next line; empty without one."""
    lines = F.split(prompt, "\n", -1)
    mark = RAG_ASKED.strip()
    at = F.array_position(F.transform(lines, lambda s: s.startswith(mark)), True)
    rest = _trim(F.replace(F.try_element_at(lines, at.cast("int")), F.lit(mark), F.lit("")))
    following = F.coalesce(_trim(F.try_element_at(lines, (at + 1).cast("int"))), F.lit(""))
    return F.when(at > 0, F.when(rest != "", rest).otherwise(following)).otherwise("")


def question_of(messages: Column) -> Column:
    """The question in the last user message that has one: behind a heading, up to the next; or a message under 500 characters itself, its first 200."""
    own = F.reverse(F.filter(messages, lambda m: m["role"] == "user"))

    def found(content: Column) -> Column:
        behind = lambda mark: _trim(F.element_at(F.split(F.element_at(F.split(content, mark, -1), -1), "##", -1), 1))
        long, short = RAG_ASKED.strip(), QUICK_ASKED.strip()
        return F.when(content.contains(long), behind(long)).when(content.contains(short), behind(short)).when(F.length(content) < 500, F.substring(content, 1, 200))

    each = F.filter(F.transform(own, lambda m: found(F.coalesce(m["content"], F.lit("")))), lambda q: q.isNotNull())
    return F.coalesce(F.try_element_at(each, F.lit(1)), F.lit(""))


def _lines(*parts: str | Column) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _because(reason: Column) -> Column:
    return F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("\n" + REASON), reason))


def refusal(question: Column, reason: Column | None = None) -> Column:
    """The answer when nothing was found."""
    said = F.concat(F.lit(NOT_FOUND[0]), question, F.lit(NOT_FOUND[1]))
    return _lines(CONCLUSION, said, "", GROUNDS, NONE, "", SOURCES, NONE, "", OPEN, "-", "", NEXT, REPHRASE, *([_because(reason)] if reason is not None else []))


def abstention(question: Column, reason: Column | None = None) -> Column:
    """The agent's answer when it abstains."""
    return _lines(CONCLUSION, F.concat(F.lit(NOT_ENOUGH), question), "", GROUNDS, NOT_RELATED, *([_because(reason)] if reason is not None else []), "", NEXT, *TRY_AGAIN)


def without_model(question: Column, sources: Column) -> Column:
    """The answer without a model: the sources (array of struct<filename,page>) by number, a refusal if there are none."""
    ref = lambda s, i: F.concat(F.lit("> ["), i + 1, F.lit("] 文件: "), F.coalesce(s["filename"], F.lit("")), F.when(F.coalesce(s["page"], F.lit("")) != "", F.concat(F.lit(" | 页码: "), s["page"])).otherwise(""))
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, _lines(CONCLUSION, COVERED, "", SOURCES, F.array_join(F.transform(sources, ref), "\n"), "", OPEN, NO_MODEL)).otherwise(refusal(question))
