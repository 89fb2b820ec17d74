"""The retrieval agent as a batch: all questions go through the same bounded rounds of tables at once.

A round: questions that retrieve (and plans' missing hops) search once, the evidence bank grows, hops are scored anew, and the
decision rules give each question its next action. Decisions end at ACCEPT or ABSTAIN, or when the budget is used up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_multi_part
from . import fusion, gates
from .storage import materialize


@dataclass(frozen=True)
class Config:
    max_iterations: int = 2
    evidence: int = 5
    pool: int = 16

    @property
    def budget(self) -> int:
        return self.max_iterations + 2


def run(questions: DataFrame, search: Callable[[DataFrame], DataFrame], config: Config = Config(), scorer=fusion.lexical_scorer) -> DataFrame:
    """(query_id, decision, route, iterations, completeness, top1, evidence) of every question.

    ``search`` turns (query_id, question) into hits (query_id, id, rank, score, text, vector_score, sources).
    """
    state = questions.select(
        "query_id", "question", F.lit(config.budget).alias("budget"), F.lit(0).alias("iteration"), F.lit(False).alias("decomposed"),
        F.when(is_multi_part(F.col("question")), F.array(F.lit("DECOMPOSE"))).otherwise(F.array(F.lit("RETRIEVE"))).alias("route"),
        F.when(is_multi_part(F.col("question")), "DECOMPOSE").otherwise("RETRIEVE").alias("decision"),
    )
    state = materialize(state, "state")
    bank, hops = None, None
    for _ in range(config.budget + 1):
        active = state.where("decision in ('RETRIEVE', 'DECOMPOSE')")
        if not active.limit(1).count():
            break
        planned = active.where("decision = 'DECOMPOSE'").select("query_id", F.posexplode(gates.plan(F.col("question"))).alias("hop", "subquery"))
        hops = planned if hops is None else hops.select("query_id", "hop", "subquery").unionByName(planned)
        missing = hops.join(state.where("decision = 'RETRIEVE' and decomposed").select("query_id"), "query_id", "left_semi")
        asked = active.where("decision = 'RETRIEVE' and not decomposed").select("query_id", "question").unionByName(planned.select("query_id", F.col("subquery").alias("question"))).unionByName(missing.select("query_id", F.col("subquery").alias("question")))
        key = F.xxhash64("query_id", "question")
        asked = materialize(asked.distinct().withColumn("search_id", key), "asked")
        found = search(asked.select(F.col("search_id").alias("query_id"), "question")).withColumnRenamed("query_id", "search_id").join(asked.select("search_id", "query_id"), "search_id").drop("search_id")
        merged = found if bank is None else bank.select(*found.columns).unionByName(found)
        best = merged.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("vector_score").alias("vector_score"), F.first("text").alias("text"), F.max("sources").alias("sources"))
        bank = materialize(best.withColumn("rank", F.row_number().over(fusion.by_score("query_id"))), "bank")

        hops = materialize(hops, "hops")
        top = bank.where(F.col("rank") <= config.pool)
        per_hop = hops.join(top.select("query_id", "text"), "query_id", "left").groupBy("query_id", "hop").agg(F.coalesce(F.max(F.round(scorer(F.col("subquery"), F.col("text")), 4)), F.lit(0.0)).alias("evidence_score")).withColumn("required", F.lit(True))
        status = per_hop.withColumn("status", gates.support_status(F.col("evidence_score")))
        sums = status.groupBy("query_id").agg(F.count("*").alias("n_hops"), F.avg((F.col("status") == "SUPPORTED").cast("double")).alias("comp"), F.max(F.col("status") == "MISSING").alias("missing_hop"))
        asked_all = state.select("query_id", "question")
        first = top.join(asked_all, "query_id").groupBy("query_id").agg(F.max(F.round(scorer(F.col("question"), F.col("text")), 4)).alias("top1"))
        lexical = gates.entity_overlap(asked_all, bank, 3, 1.0).withColumnRenamed("entity_overlap", "lexical")
        verdict = gates.relevance(asked_all, bank).select("query_id", "is_relevant", "reason", "overlap")
        shares = bank.where("rank <= 3").join(asked_all, "query_id").groupBy("query_id").agg(F.max(gates.has_shared_token(F.col("question"), F.col("text"))).alias("token"))

        rows = state.drop("completeness", "top1")
        for part in (sums, first, lexical, verdict, shares):
            rows = rows.join(part, "query_id", "left")
        rows = rows.fillna({"n_hops": 0, "comp": 0.0, "missing_hop": False, "top1": 0.0, "lexical": 0.0, "is_relevant": False, "token": False})
        grade = gates.rule_grade(F.col("is_relevant"), (F.coalesce("overlap", F.lit(0.0)) > 0) | F.col("token"), F.col("question"), F.coalesce(F.col("reason") == "empty", F.lit(True)))
        was = F.col("decision").isin("RETRIEVE", "DECOMPOSE")
        rows = rows.withColumn("grade", grade).withColumn("grade_reason", F.lit("")).withColumn("was", was).withColumn("decomposed", F.col("decomposed") | (F.col("decision") == "DECOMPOSE"))
        rows = rows.withColumn("budget", F.col("budget") - was.cast("int")).withColumn("iteration", F.col("iteration") + was.cast("int")).withColumnRenamed("decision", "last")
        next_ = gates.decided(rows, config.max_iterations)
        forced = F.when(F.col("decision").isin("RETRIEVE", "DECOMPOSE") & (F.col("budget") <= 0), "ABSTAIN").otherwise(F.col("decision"))
        decision = F.when(F.col("was"), forced).otherwise(F.col("last"))
        route = F.when(F.col("was"), F.concat("route", F.array(decision))).otherwise(F.col("route"))
        state = materialize(next_.select("query_id", "question", "budget", "iteration", "decomposed", route.alias("route"), decision.alias("decision"), F.col("comp").alias("completeness"), "top1"), "state")
    order = Window.partitionBy("query_id").orderBy("rank")
    kept = bank.withColumn("n", F.row_number().over(order)).where(F.col("n") <= config.evidence)
    evidence = kept.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("evidence"))
    out = state.join(evidence, "query_id", "left")
    return out.select("query_id", "decision", "route", F.col("iteration").alias("iterations"), F.round("completeness", 4).alias("completeness"), "top1", F.when(F.col("decision") == "ACCEPT", F.col("evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"))
