"""Column functions on text: language, metadata, sanitising, line filters and cleanup rules.

Patterns are written so that Java's and RE2's dialects agree on them. White space is ASCII white space unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# CJK ideographs, and the classes that the rules below are made of.
CJK = "一-鿿"
WORDY = f"[{CJK}A-Za-z0-9]"
ENGLISH_FAST = 0.40
ENGLISH_SLOW = 0.25


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


#: Letters that have several in upper case, and the one that stands for them: the title form, or themselves.
_SEVERAL = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(128, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1}


def upper(c: Column) -> Column:
    """Upper case letter by letter, so that the length stays: ß is ẞ, and ligatures stay. For short texts."""
    one = lambda x: F.when(F.length(F.upper(x)) > 1, F.translate(x, "".join(_SEVERAL), "".join(_SEVERAL.values()))).otherwise(F.upper(x))
    return F.array_join(F.transform(F.split(c, ""), one), "")


def lines_of(c: Column) -> Column:
    return F.split(c, "\n", -1)


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def with_stripped(lines: Column) -> Column:
    """(line, bare): each line and what ``strip`` leaves of it, so that rules over a line strip it once."""
    return F.transform(lines, lambda s: F.struct(s.alias("line"), strip(s).alias("bare")))


def wordy(t: Column) -> Column:
    """Characters of ``WORDY``: what goes with their runs, which makes no array of them as ``count_of`` does."""
    return F.length(t) - F.length(F.regexp_replace(t, f"{WORDY}+", ""))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def is_mostly_english(t: Column) -> Column:
    """More than 40 % ASCII letters; or more than 25 % and over twice as many ASCII words as CJK characters."""
    n, letters = F.length(t), F.length(F.regexp_replace(t, "[^a-zA-Z]", ""))
    words, cjk = count_of(t, "[a-zA-Z]+"), count_of(t, f"[{CJK}]")
    return F.when(strip(t) == "", F.lit(False)).otherwise((letters > n * ENGLISH_FAST) | ((letters > n * ENGLISH_SLOW) & (words > cjk * 2)))


def doi(t: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(t, r"(?i)DOI\s*[:\s]\s*(10\.\S+)", 1), r"\.+$", "")


def title(t: Column) -> Column:
    """The first of the first thirty lines that could be a title."""
    lines = F.transform(F.slice(lines_of(strip(t)), 1, 30), strip)
    good = F.filter(lines, lambda s: (F.length(s) >= 5) & ~s.rlike(r"^\d+$") & ~s.rlike("(?i)^(IEEE|arXiv|Proceedings|Conference|Abstract|Keywords|Index)"))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), F.lit("")), 1, 200)


def abstract(t: Column) -> Column:
    return F.substring(strip(F.regexp_extract(t, r"(?is)(?:Abstract|摘要)[：\s:]*\n*(.*?)(?=\n\s*(?:Index\s+Terms|Keywords|Introduction|Ⅰ|1\.\s|I\.\s))", 1)), 1, 500)


#: Heading lines: numbered chapters, and the usual names of sections (fixed values).
SECTION = (
    r"^(?:第[一二三四五六七八九十]+章|[一二三四五六七八九十]+\.|[ⅠⅡⅢⅣⅤ]+\.)\s*.+$"
    "|(?i)^(?:Introduction|Background|Methods|Methodology|Results|Discussion|Conclusion|Related Work|Experiments|参考文献|References|引言|方法|结果|讨论|结论|相关工作)"
)


def sections(t: Column) -> Column:
    found = F.filter(F.transform(lines_of(strip(t)), strip), lambda s: s.rlike(SECTION))
    return F.transform(found, lambda s: F.substring(s, 1, 100))


def sanitized(t: Column) -> Column:
    """Keeps line feeds, printable ASCII, U+00A0 to U+D7FE and everything beyond the first plane."""
    return F.regexp_replace(t, "[^\\n\\x{20}-\\x{7E}\\x{A0}-\\x{D7FE}\\x{10000}-\\x{10FFFF}]", "")


# pages -----------------------------------------------------------------------------------------


def is_page_noise(line: Column) -> Column:
    """Lines that are dropped from pages: numbers, DOIs, running heads, formula debris, false table rows."""
    s = strip(line)
    parts = F.split(s, r"\|", -1)
    false_row = s.contains("|") & ~s.contains("---") & (F.size(parts) <= 4) & F.forall(parts, lambda p: (strip(p) == "") | (F.length(strip(p)) > 10))
    head = s.rlike(r"^\d+\s+[A-Z][a-z]+.*Conference|^Proceedings|^IEEE|^arXiv:\d") & (F.length(s) < 100)
    debris = s.rlike(r"^[\d\sx×NnKCc\-|/:]{3,}$") & (F.length(s) < 60)
    return s.rlike(r"^\d+$") | s.rlike(r"(?i)^DOI:\s*10\.") | head | debris | false_row


def page_lines(t: Column) -> Column:
    """The text without noise lines, hyphenation undone, ligatures, dashes and bullets made plain."""
    text = joined(F.filter(lines_of(t), lambda line: ~is_page_noise(line)))
    text = F.regexp_replace(text, r"([a-zA-Z]+)-\s*\n\s*([a-zA-Z]+)", "$1$2")
    text = F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.regexp_replace(text, "[–—•●▪▶]", "-")


def is_table_row(line: Column) -> Column:
    """At least twenty characters, three fields and a digit."""
    s = strip(line)
    return (F.length(s) >= 20) & ((F.size(F.split(s, r"\s{2,}")) >= 3) | (F.size(F.split(s, r"\s+")) >= 3)) & s.rlike(r"\d")


def flattened_columns(t: Column) -> Column:
    """Short lines of a page of two columns: all left halves, then all right halves; other texts stay."""
    keep = t.rlike(r"(?m)^#{1,3}\s+\S") | t.rlike("(?m)^[一二三四五六七八九十]+、") | t.rlike(r"(?m)^[-|]+\s*$") | t.contains("├──")
    lines = F.filter(lines_of(t), lambda s: strip(s) != "")
    sizes = F.array_sort(F.transform(lines, lambda s: F.length(strip(s))))
    n = F.size(lines)
    mean = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.greatest(n, F.lit(1))
    narrow = (n >= 30) & (mean <= 60) & (F.get(sizes, F.floor(n / 2).cast("int")) < 50)
    half = lambda s: F.floor(F.length(s) / 2).cast("int")
    left = F.transform(lines, lambda s: strip(F.substring(s, F.lit(1), half(s))))
    right = F.transform(lines, lambda s: strip(F.substring(s, half(s) + 1, F.length(s))))
    return F.when(~keep & narrow, joined(F.concat(left, right))).otherwise(t)


def markdown_text(t: Column) -> Column:
    """Without images, and without the lines that open or close a code fence (what they fence stays)."""
    text = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", "")
    return joined(F.filter(lines_of(text), lambda s: ~strip(s).startswith("```")))


def is_scanned(chars: Column, pages: Column) -> Column:
    """Under fifty characters a page; no pages at all count as scanned."""
    return (pages == 0) | (chars / F.greatest(pages, F.lit(1)) < 50)


# cleanup rules ---------------------------------------------------------------------------------
# Each gives the text; its trace entry says whether it passed.


def unicode_normalized(t: Column) -> Column:
    text = F.regexp_replace(t, "[\\x{200B}-\\x{200F}\\x{FEFF}\\x{2060}\\x{2061}]", "")
    text = F.replace(F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("ﬀ"), F.lit("ff"))
    return F.regexp_replace(text, "[\\x00-\\x09\\x0B\\x0C\\x0E-\\x1F]", "")


def collapsed_blanks(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"(?m)^\s*\n", "\n")


def is_footer(line: Column) -> Column:
    return _footer(strip(line))


def _footer(s: Column) -> Column:
    return (s.rlike(r"^\d+$") & (F.length(s) < 6)) | s.rlike(r"(?i)^DOI\s*[:\s]\s*10\.\S+") | s.rlike(r"^arXiv:\d{4}\.\d+") | s.rlike(r"^https?://\S+$") | s.rlike(r"^©\s*\d{4}")


def without_footers(t: Column) -> Column:
    return joined(F.filter(lines_of(t), lambda s: ~is_footer(s)))


NUMBERED = r"^(第[一二三四五六七八九十]+[章节]|（?\d+[、.．]|[一二三四五六七八九十]+[、.．])"


def is_loose_heading(line: Column) -> Column:
    return _loose_heading(strip(line))


def _loose_heading(s: Column) -> Column:
    plain = (s != "") & ~s.startswith("#") & (F.length(s) <= 60) & ~s.rlike("[.。！？]$")
    numbered = s.rlike(NUMBERED) & ~s.rlike("[：:]") & (F.length(F.regexp_replace(s, NUMBERED, "")) <= 20)
    return plain & (numbered | s.rlike(r"^[A-Z][A-Z\s]{2,40}$") | s.rlike(r"^[ⅠⅡⅢⅣⅤ]+\."))


def normalized_headings(t: Column) -> Column:
    return F.when(t.rlike(MARKED), t).otherwise(joined(_headed(with_stripped(lines_of(t)))["line"]))


MARKED = r"(?m)^#{1,3}\s+\S"


def _headed(lines: Column) -> Column:
    """Loose headings among lines (line, bare) with their mark."""
    mark = lambda x: F.concat(F.lit("## "), x["bare"])
    return F.transform(lines, lambda x: F.when(_loose_heading(x["bare"]), F.struct(mark(x).alias("line"), mark(x).alias("bare"))).otherwise(x))


def low_value_share(t: Column) -> Column:
    """Lines of digits and marks only, or under three characters, as a share of lines that aren't blank."""
    return _low_share(F.transform(lines_of(t), strip))


def _low_share(bare: Column) -> Column:
    low = lambda s: (s.rlike(r"^[\d\s,./\-|\\()]+$") & (F.length(s) > 3)) | ((F.length(s) < 3) & ~s.rlike("^[#!]"))
    share = lambda lines: F.size(F.filter(lines, low)) / F.greatest(F.size(lines), F.lit(1))
    # in an array of one, the lines are worked out once for both sizes
    return F.transform(F.array(F.filter(bare, lambda s: s != "")), share)[0]


def content_ratio(t: Column) -> Column:
    return wordy(t) / F.greatest(F.length(F.regexp_replace(t, r"\s", "")), F.lit(1))


def has_heading(t: Column) -> Column:
    return t.rlike(r"(?m)^##?\s+\S")


def cleanup(df: DataFrame, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """Adds ``cleanup``: the text after the five rules in order, their trace, and the gate's verdict with its figures.

    The struct comes out of a generator of one row: filters on it stay above, where the optimizer would else work out all rules anew for each of their uses.
    """
    t = F.col(text)
    one = df.withColumn("__1", unicode_normalized(t)).withColumn("__2", collapsed_blanks(F.col("__1")))
    lines = one.withColumn("__lines", with_stripped(lines_of(F.col("__2"))))
    kept = lines.withColumn("__kept", F.filter("__lines", lambda x: ~_footer(x["bare"])))
    # lines are split and stripped once: a heading's mark leaves the others as they are
    headed = kept.withColumn("__headed", F.when(joined(F.col("__kept")["line"]).rlike(MARKED), F.col("__kept")).otherwise(_headed(F.col("__kept"))))
    last = headed.withColumn("__4", joined(F.col("__headed")["line"]))
    figures = last.withColumn("__low", _low_share(F.col("__headed")["bare"])).withColumn("__wordy", wordy(F.col("__4"))).withColumn("__solid", F.length(F.regexp_replace("__4", r"\s", "")))
    trace = [
        ("unicode_normalize", F.length(t) - F.length("__1") < F.length(t) * 0.1),
        ("collapse_blanks", F.lit(True)),
        ("remove_footers", F.size("__lines") - F.size("__kept") < F.size("__kept")),
        ("normalize_headings", F.lit(True)),
        ("detect_low_value", F.col("__low") < 0.5),
    ]
    rated = figures.withColumn("__rate", sum(ok.cast("int") for _, ok in trace) / len(trace)).withColumn("__ratio", F.col("__wordy") / F.greatest(F.col("__solid"), F.lit(1)))
    scored = rated.withColumn("__score", F.col("__rate") * 0.4 + F.col("__ratio") * 0.3 + has_heading(F.col("__4")).cast("int") * 0.3)
    gated = scored.withColumn("__blocked", (F.col("__ratio") < 0.05) | (F.col("__wordy") < 20)).withColumn("__passed", (F.col("__score") >= min_score) & ~F.col("__blocked"))
    flags = F.array(F.when(F.col("__low") > 0.3, "high_noise_ratio"), F.when(~F.col("__passed"), "quality_gate_blocked"), F.when(~F.col("__passed") & F.col("__blocked"), "content_ratio_too_low"))
    out = F.struct(
        F.col("__4").alias("text"),
        F.array(*(F.struct(F.lit(name).alias("rule"), ok.alias("passed")) for name, ok in trace)).alias("trace"),
        F.round("__score", 3).alias("score"),
        F.col("__passed").alias("passed"),
        F.filter(flags, lambda f: f.isNotNull()).alias("flags"),
        F.round("__ratio", 3).alias("content_ratio"),
        F.round("__rate", 3).alias("rules_pass_rate"),
    )
    return gated.select(*df.columns, F.explode(F.array(out)).alias("cleanup"))


# questions -------------------------------------------------------------------------------------

#: Named patterns of prompt injection in order; the first match names the category (fixed values).
INJECTION = [
    ("system_prompt_override", r"ignore\s+(all\s+)?(previous|prior)\s+(instructions|directives|commands)"),
    ("system_prompt_override", r"forget\s+(all\s+)?(your\s+)?(role|persona|identity|system\s+prompt)"),
    ("system_prompt_override", r"(?s)you\s+are\s+(now|not\s+required\s+to)\b.*(doctor|assistant|expert|ai)"),
    ("system_prompt_override", r"new\s+(system\s+)?(prompt|instruction|rule)"),
    ("system_prompt_override", r"\boverride\b"),
    ("system_prompt_override", r"disregard|discard\s+(all\s+)?(rules|instructions|guidelines)"),
    ("jailbreak", r"dan|jailbreak|do\s+anything\s+now|no\s+(restrictions|limitations|boundaries)"),
    ("jailbreak", r"act\s+as\s+(if\s+you\s+are|though\s+you\s+are)\s+"),
    ("jailbreak", r"pretend\s+(to\s+be|that\s+you\s+are|you\s+are)"),
    ("medical_boundary", r"how\s+to\s+(make|create|synthesize|produce)\s+(a\s+)?(drug|medicine|poison)"),
    ("medical_boundary", r"ignore\s+(medical|clinical|safety|ethical)\s+(guidelines|protocol|rules)"),
    ("medical_boundary", r"give\s+me\s+(a\s+)?(prescription|diagnosis)\s+(for|without)\s+"),
    ("prompt_leak", r"(what\s+is|show|display|reveal|output)\s+(me\s+)?(your\s+)?(system\s+)?prompt"),
    ("prompt_leak", r"print\s+(your\s+)?(instructions|directives|guidelines|rules)"),
    ("prompt_leak", r"(show|reveal|output)\s+(me\s+)?(the\s+)?(initial|first)\s+(prompt|message)"),
    ("system_prompt_override", "(忽略|忘记|无视|遗忘|覆盖|跳过)(之前|先前|所有|以上|任何|一切|的|你)*?(指令|规则|要求|提示词|提示|系统提示|设定|角色)"),
    ("system_prompt_override", "(你|您)(现在|从现在起|接下来|开始)?(要|必须|请)?(扮演|假装|作为|当|是)(一个|一名)?(医生|专家|助手|AI|人工智能)"),
    ("system_prompt_override", "(新的|新)(系统提示|指令|规则|要求)"),
    ("jailbreak", "(不受|没有|无需)(任何)?(限制|约束|边界)"),
    ("jailbreak", "(做|执行|干)(任何|任意)(事情|操作|事)"),
    ("medical_boundary", "(如何|怎么)(制造|合成|制作|配制)(药物|药品|毒药|毒品)"),
    ("medical_boundary", r"(忽略|无视)(医学|临床|安全|伦理)[^，。；\n]{0,6}?(准则|规范|规则|指南)"),
    ("medical_boundary", "(给我|帮我)(开|写)(处方|药方)"),
    ("prompt_leak", "(你的|您的)(系统)?(提示词|提示|指令|规则|要求|prompt)(是什么|有哪些|给我看|显示)"),
    ("prompt_leak", "(输出|显示|泄露)(你的|您的)?(系统)?(提示词|提示|指令|规则|初始提示)"),
]

#: Topics outside the domain (fixed values).
OUT_OF_DOMAIN = [
    "经济增长|GDP|股票|基金|汇率|期货",
    "Kubernetes|RBAC|CloudFormation|goroutine|区块链|PoW|PoS",
    "量子纠错|量子计算|科举|殿试|会试|非洲猪瘟|日语敬语|电动车锂电池",
    "React|useEffect|useLayoutEffect|async/await|Nginx|异步编程",
]

#: What makes a question worth rewriting (fixed values).
REWRITE = [
    "(什么|如何|为什么|怎样|哪些|哪个|怎么|可否|是否)",
    "(症状|治疗|诊断|检查|方案|预后|机制|病因|预防)",
    "(区别|对比|关系|联系|影响|作用)",
    "(如果|假如|没有|不是|除了|条件)",
    r"\b(what|how|why|which|when|where|who|whose|whom)\b",
    r"\b(diagnosis|treatment|symptoms|signs|risk|therapy|imaging|management|prognosis|prevention)\b",
]
UNSUPPORTED_HINTS = ("未提及", "未找到", "不存在", "没有提及", "无相关")


def injection_category(t: Column) -> Column:
    """The category of the first pattern that matches; null for none and for blank texts."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(INJECTION):
        out = F.when(t.rlike("(?i)" + pattern), name).otherwise(out)
    return F.when(strip(t) != "", out)


def is_out_of_domain(q: Column) -> Column:
    return q.rlike("(?i)" + "|".join(OUT_OF_DOMAIN))


def needs_rewrite(q: Column) -> Column:
    return (F.length(q) > 15) | q.rlike("(?i)" + "|".join(REWRITE))


def english_entities(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"[A-Za-z][A-Za-z0-9\-]{2,}"), 0)


def is_multi_part(q: Column) -> Column:
    """Two question marks or more, unless both parts name one entity or the second is a bare follow-up."""
    parts = F.filter(F.split(F.replace(q, F.lit("?"), F.lit("？")), "？", -1), lambda p: strip(p) != "")
    marks = F.length(q) - F.length(F.regexp_replace(q, "[?？]", ""))
    first, second = english_entities(F.lower(F.get(parts, F.lit(0)))), english_entities(F.lower(F.get(parts, F.lit(1))))
    follow_up = F.arrays_overlap(first, second) | ((F.length(F.get(parts, F.lit(1))) <= 8) & (F.size(second) == 0))
    return (marks >= 2) & ~F.coalesce((F.size(parts) >= 2) & follow_up, F.lit(False))


def is_comparison(q: Column) -> Column:
    return q.rlike("区别|对比|异同") | (q.rlike("和|与") & q.rlike("分别|各") & q.rlike(r"[A-Za-z][A-Za-z0-9\-]{2,}"))


def is_time_sensitive(q: Column) -> Column:
    return q.rlike(r"(?:20|19)\d{2}\s*年")


def hints_unsupported(reason: Column) -> Column:
    return reason.rlike("|".join(UNSUPPORTED_HINTS))
