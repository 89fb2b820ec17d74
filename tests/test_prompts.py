"""Prompts, refusals, gold metrics and criteria on hand-made rows."""

from pyspark.sql import functions as F

from docloom.operators import evaluation as E, prompts as P


def test_prompts_and_the_question_back(spark):
    asked = spark.createDataFrame([(1, "what is it"), (2, "nothing found")], "query_id int, question string")
    hits = spark.createDataFrame([(1, i, f"f{i}", "S" if i == 1 else "", "t" * i, None, 0.5) for i in (3, 1, 2)], "query_id int, rank int, filename string, section_title string, text string, parent_content string, score double")
    rag, quick = ({r.query_id: r for r in f(asked, hits, "be brief").collect()} for f in (P.rag_prompt, P.quick_prompt))
    assert rag[1].messages[0].content == "be brief"
    assert rag[1].messages[1].content == "请根据以下参考文档回答用户问题。\n## 参考文档\n[1] 文件: f1 | 章节: S\nt\n\n[2] 文件: f2\ntt\n\n[3] 文件: f3\nttt\n\n## 用户问题\nwhat is it\n\n## 回答\n"
    assert quick[1].messages[1].content == "请用最简洁的方式回答下面的医学问题。\n## 参考文档\n[1] 文件: f1 | 章节: S\nt\n\n[2] 文件: f2\ntt\n\n\n## 问题\nwhat is it\n\n## 快速回答\n"
    assert set(quick[1].source_map) == {"1", "2"} and quick[1].source_map["2"].filename == "f2"
    assert "（无参考文档）" in rag[2].messages[1].content and "（无）" in quick[2].messages[1].content and rag[2].source_map is None
    for df in (P.rag_prompt(asked, hits), P.quick_prompt(asked, hits)):
        assert {r.query_id: r.q for r in df.select("query_id", P.question_of(F.col("messages")).alias("q")).collect()} == {1: "what is it", 2: "nothing found"}


def test_questions_of_odd_prompts(spark):
    rows = [("", ""), ("## 用户问题 inline", "inline"), ("a\n## 用户问题\n  below \nc", "below"), ("## 用户问题", ""), ("none", "")]
    found = spark.createDataFrame(rows, "p string, want string").select("want", P.question_of_prompt(F.col("p")).alias("q")).collect()
    assert all(r.q == r.want for r in found)
    none = spark.range(1).select(P.question_of(F.array().cast(P.MESSAGE)).alias("q")).first()
    assert none.q == ""


def test_refusals(spark):
    row = spark.createDataFrame([("Q", None, "R")], "q string, none string, why string").select(P.refusal(F.col("q"), F.col("why")).alias("a"), P.refusal(F.col("q"), F.col("none")).alias("b"), P.abstention(F.col("q"), F.col("why")).alias("c"), P.abstention(F.col("q")).alias("d")).first()
    assert row.a == row.b + "\n\n> 📊 拒答原因: R" and row.b.startswith('**结论：**\n知识库中未找到与"Q"相关的依据。\n\n**依据：**\n无\n\n**引用来源：**\n无\n')
    assert row.c.split("\n\n")[2:] == ["> 📊 拒答原因: R", row.d.split("\n\n")[2]] and row.d.split("\n\n")[2].startswith("**建议下一步：**\n1. ")


def test_chunk_level_without_labels(spark):
    kind = "expected_doc string, gold_answerability string, gold_chunk_ids array<string>, expected_hit boolean, correct_refusal boolean"
    rows = spark.createDataFrame([("d", None, None, None, None), ("d", "partial", [], True, None), (None, "partial", None, None, None)], kind)
    assert tuple(E.chunk_level(rows).first()) == (0.0, 0, 0, 0.0) and {r.answerability: r.n for r in E.answerability(rows).collect()} == {"unlabeled": 1, "partial": 1}
    some = spark.createDataFrame([("d", "unsupported", ["c"], True, True), ("d", "unsupported", ["c"], False, False), ("d", "unsupported", None, True, None)], kind)
    assert tuple(E.chunk_level(some).first()) == (0.5, 3, 1, 0.3333)
    assert tuple(E.chunk_level(rows.limit(0)).first()) == (0.0, 0, 0, 0.0)


def test_exit_criteria(spark):
    good = spark.createDataFrame([(0, 3, 3, 0, 0, 0.8, 1)], "harm int, ood int, ood_rejected int, false_abstain int, unnecessary int, evidence_recall double, decomposition_success int")
    assert all(r.ok for r in E.exit_criteria(good).collect()) and E.exit_criteria(good).count() == 6
    bad = good.selectExpr("1 harm", "ood", "2 ood_rejected", "1 false_abstain", "1 unnecessary", "0.79D evidence_recall", "0 decomposition_success")
    assert not any(r.ok for r in E.exit_criteria(bad).collect())
    assert {r.criterion for r in E.exit_criteria(good.withColumn("evidence_recall", F.lit(None).cast("double"))).where("not ok").collect()} == {"evidence_recall"}


def test_golden_hits(spark):
    rows = [("a_guide.pdf", "a_guide.pdf", True), ("a_guide.pdf", "a_guide", True), ("a_guide.pdf", "guide v2.pdf", True), ("guide.pdf", "guide v2.pdf", True), ("guide.pdf", "other", False), ("", "x", False), ("a_b_c.md", "b_c", True)]
    found = spark.createDataFrame(rows, "e string, f string, want boolean").select("want", E.golden_hit(F.col("e"), F.col("f")).alias("hit")).collect()
    assert all(r.hit == r.want for r in found)
