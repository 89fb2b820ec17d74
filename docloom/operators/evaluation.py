"""Evaluation as aggregations: retrieval, refusal, rescue, evidence, route and log metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def share(condition: Column, of: Column | None = None) -> Column:
    """The share of rows (among those of ``of``) that meet a condition; 0 without any."""
    value = condition.cast("double")
    return F.coalesce(F.avg(value if of is None else F.when(of, value)), F.lit(0.0))


def target_match(filename: Column, target: Column) -> Column:
    """Equal to the target, or to the target without its last extension."""
    return (filename == target) | (filename == F.regexp_replace(target, r"\.[^.]*$", ""))


def hit_ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, hit_rank): the first rank at which a gold file stands; null if none does."""
    good = gold.select("query_id", F.col("filename").alias("gold"))
    met = hits.join(good, "query_id").where(target_match(F.col("filename"), F.col("gold")))
    return met.groupBy("query_id").agg(F.min("rank").alias("hit_rank"))


def metrics(records: DataFrame, k: int = 5) -> DataFrame:
    """All figures over the whole, each category and each difficulty, in one pass (grouping sets).

    Records: category, difficulty, hit_rank, correct_refusal, is_refusal, n_files, num_retrieved, top_score, seconds.
    """
    exact, ood = F.col("category") == "exact_match", F.col("category") == "out_of_knowledge"
    tp, fn = F.sum((ood & F.col("correct_refusal")).cast("int")), F.sum((ood & ~F.col("correct_refusal")).cast("int"))
    fp = F.sum((~ood & ~F.col("correct_refusal") & F.col("is_refusal")).cast("int"))
    rr = F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))
    gain = F.when(F.col("hit_rank") <= k, 1 / F.log2(F.col("hit_rank") + 1.0)).otherwise(0.0)
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, c)), F.lit(0.0))
    grouped = records.groupingSets([[], [F.col("category")], [F.col("difficulty")]], F.col("category"), F.col("difficulty"))
    raw = grouped.agg(
        F.count("*").alias("n"),
        share(F.col("hit_rank").isNotNull(), exact).alias("hit_rate"),
        mean(rr, exact).alias("mrr"),
        mean(gain, exact).alias("ndcg"),
        share(F.col("correct_refusal")).alias("refusal_accuracy"),
        tp.alias("tp"), fn.alias("fn"), fp.alias("fp"),
        share(~F.col("correct_refusal"), ood).alias("false_positive_rate"),
        mean(F.col("n_files").cast("double"), F.col("num_retrieved") > 0).alias("passage_diversity"),
        mean(F.col("top_score"), F.col("top_score") > 0).alias("semantic_score"),
        F.avg("seconds").alias("avg_seconds"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    r = lambda c, d=4: F.round(c, d)
    return raw.withColumn("p", precision).withColumn("r", recall).select(
        F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("difficulty", F.lit("*")).alias("difficulty"), "n", r("hit_rate").alias("hit_rate"), r("mrr").alias("mrr"), r("ndcg").alias("ndcg"),
        r("refusal_accuracy").alias("refusal_accuracy"), r("p").alias("precision"), r("r").alias("recall"), r(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))).alias("f1"),
        r("false_positive_rate").alias("false_positive_rate"), r("passage_diversity", 2).alias("passage_diversity"), r("semantic_score").alias("semantic_score"), r("avg_seconds", 2).alias("avg_seconds"),
    )


def groundedness(claims: DataFrame) -> DataFrame:
    """The mean over answers of their supported share, and the unsupported share of all factual claims."""
    factual = claims.where("status <> 'unverifiable'")
    per = factual.groupBy("query_id").agg(F.sum((F.col("status") == "supported").cast("int")).alias("good"), F.sum((F.col("status") == "unsupported").cast("int")).alias("bad"), F.count("*").alias("n"))
    return per.agg(F.round(F.avg(F.col("good") / F.col("n")), 3).alias("groundedness"), F.round(F.sum("bad") / F.greatest(F.sum("n"), F.lit(1)), 3).alias("unsupported_claim_rate"))


# rescue and evidence ---------------------------------------------------------------------------


def pair_class(before: Column, after: Column) -> Column:
    return F.when(~before & after, "rescue").when(before & ~after, "harm").when(before & after, "both").otherwise("none")


def rescue(records: DataFrame) -> DataFrame:
    """Rescues, harms and net utility of (before, after), and of pools and lists (pool_before, pool_after, after)."""
    n = lambda c: F.sum(c.cast("int"))
    kind = pair_class(F.col("before"), F.col("after"))
    return records.agg(
        n(kind == "rescue").alias("rescue"), n(kind == "harm").alias("harm"), (n(kind == "rescue") - n(kind == "harm")).alias("net_utility"),
        n(~F.col("pool_before") & F.col("pool_after")).alias("candidate_rescue"), n(F.col("pool_after") & F.col("after")).alias("rerank_rescue"), n(F.col("pool_after") & ~F.col("after")).alias("rerank_failure"),
    )


def evidence_metrics(gold: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, evidence_recall, hop_recall): of (query_id, hop, id) gold among the first k hits."""
    top = hits.where(F.col("rank") <= k).select("query_id", "id", F.lit(True).alias("found")).distinct()
    met = gold.distinct().join(top, ["query_id", "id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    per_id = met.groupBy("query_id", "id").agg(F.max("found").alias("found")).groupBy("query_id").agg(F.avg(F.col("found").cast("double")).alias("evidence_recall"))
    per_hop = met.groupBy("query_id", "hop").agg(F.max("found").alias("found")).groupBy("query_id").agg(F.avg(F.col("found").cast("double")).alias("hop_recall"))
    return per_id.join(per_hop, "query_id")


def cross_document(gold: DataFrame, hits: DataFrame, k: int = 8) -> DataFrame:
    """One row of means over questions: recall of gold files, files covered, reciprocal rank, full coverage, any."""
    files = hits.where(F.col("rank") <= k).groupBy("query_id", "filename").agg(F.min("rank").alias("rank"))
    met = gold.select("query_id", "filename").distinct().join(files, ["query_id", "filename"], "left")
    per = met.groupBy("query_id").agg(F.count("*").alias("n"), F.count("rank").alias("got"), F.min("rank").alias("first"))
    return per.agg(
        F.round(F.avg(F.col("got") / F.col("n")), 4).alias("doc_recall"), F.round(F.avg("got"), 4).alias("coverage"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
        F.round(share(F.col("got") == F.col("n")), 4).alias("full_coverage"), F.round(share(F.col("got") > 0), 4).alias("at_least_one"),
    )


# routes ----------------------------------------------------------------------------------------


def _inner(route: Column) -> Column:
    return F.filter(F.slice(route, 2, F.greatest(F.size(route) - 2, F.lit(0))), lambda a: a.isin("RETRIEVE", "DECOMPOSE"))


def policy_action_accuracy(route: Column, expected: Column) -> Column:
    last, aim = F.element_at(route, -1), F.try_element_at(expected, F.lit(-1))
    acted = (F.size(_inner(route)) > 0) | ((F.element_at(route, 1) == "DECOMPOSE") & (F.size(route) >= 2))
    return F.when(F.size(expected) == 0, last == "ABSTAIN").when(last != aim, False).when(last == "ABSTAIN", True).when(F.size(expected) == 2, F.size(_inner(route)) == 0).otherwise(acted)


def route_metrics(records: DataFrame) -> DataFrame:
    """Adds to (type, route, expected_route, hit): policy_ok, unnecessary, retry_recovery, decomposition_success."""
    r, hit = F.col("route"), F.col("hit")
    accepted = (F.element_at(r, -1) == "ACCEPT") & hit
    return records.withColumns({
        "policy_ok": policy_action_accuracy(r, F.col("expected_route")),
        "unnecessary": (F.col("type") == "easy_single_hop") & (F.size(_inner(r)) > 0),
        "retry_recovery": F.array_contains(_inner(r), "RETRIEVE") & accepted,
        "decomposition_success": F.array_contains(r, "DECOMPOSE") & accepted,
    })


def final_answer_ok(answer: Column, expected: Column) -> Column:
    """The expected text is in the answer, white space aside; answers in fences and JSON are unpacked."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(answer)
    data = F.from_json(body, "diagnosis string, evidence array<string>")
    text = F.concat_ws(" ", data["diagnosis"], F.array_join(data["evidence"], " "))
    whole = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", text).otherwise(body)
    solid = lambda c: F.regexp_replace(c, r"\s+", "")
    return (F.trim(expected) != "") & F.contains(solid(whole), solid(expected))


def capability(records: DataFrame) -> DataFrame:
    """Over all and by type: (type, evidence_recall, hop_recall, hit, policy_ok, unnecessary, retry_recovery, decomposition_success, answer_ok, abstained)."""
    ood = F.col("type") == "unsupported_ood"
    n = lambda c: F.sum(c.cast("int"))
    rows = records.groupingSets([[], [F.col("type")]], F.col("type")).agg(
        F.count("*").alias("n"), F.round(F.avg("evidence_recall"), 3).alias("evidence_recall"), F.round(F.avg("hop_recall"), 3).alias("hop_recall"), n(F.col("policy_ok")).alias("policy_ok"), n(F.col("unnecessary")).alias("unnecessary"),
        n(F.col("retry_recovery")).alias("retry_recovery"), n(F.col("decomposition_success")).alias("decomposition_success"), n(F.col("answer_ok")).alias("answer_ok"), n(ood & F.col("abstained")).alias("ood_reject"), n(~ood & F.col("abstained")).alias("false_abstain"),
    )
    return rows.withColumn("type", F.coalesce("type", F.lit("*")))


def failure_surfaces(r: DataFrame) -> DataFrame:
    """(id, surfaces) in order of precedence from route, expected_route, abstained, evidence_recall, answer_ok."""
    expects = (F.size("expected_route") == 0) | F.coalesce(F.try_element_at("expected_route", F.lit(-1)) == "ABSTAIN", F.lit(False))
    refusal = F.col("abstained") != expects
    same_end = F.coalesce(F.try_element_at("route", F.lit(-1)) == F.try_element_at("expected_route", F.lit(-1)), F.lit(False))
    policy = (F.size("expected_route") > 0) & same_end & ~policy_action_accuracy(F.col("route"), F.col("expected_route"))
    retrieval = ~F.col("abstained") & (F.col("evidence_recall") < 1.0)
    generation = ~F.col("abstained") & ~F.col("answer_ok") & ~refusal & ~policy & ~retrieval
    return r.select("id", F.array_compact(F.array(F.when(refusal, "refusal"), F.when(policy, "policy"), F.when(retrieval, "retrieval"), F.when(generation, "generation"))).alias("surfaces"))


REQUIRED = ("id", "discovered", "problem", "expected_behavior", "root_cause", "fix", "verification", "status")
STATUSES = ("open", "investigating", "fixing", "verifying", "closed")


def audit(cases: DataFrame, required=REQUIRED, closed=("root_cause", "fix", "verification")) -> DataFrame:
    """(id, violation) of a registry: missing fields, unknown status, malformed date, repeated id, closed without its fields."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    nth = F.count("*").over(Window.partitionBy("id"))
    found = F.array_compact(F.array(
        *(F.when(blank(c), F.lit(f"missing {c}")) for c in required),
        F.when(~blank("status") & ~F.col("status").isin(*STATUSES), F.lit("status")),
        F.when(~blank("discovered") & ~F.col("discovered").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("discovered")),
        F.when(nth > 1, F.lit("repeated id")),
        *(F.when((F.col("status") == "closed") & blank(c), F.lit(f"closed without {c}")) for c in closed),
    ))
    return cases.withColumn("v", found).select("id", F.explode("v").alias("violation"))


def parity(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """How many of the common questions agree in each column, null-safely."""
    met = a.select("query_id", *(F.col(c).alias(f"a_{c}") for c in columns)).join(b.select("query_id", *(F.col(c).alias(f"b_{c}") for c in columns)), "query_id")
    return met.agg(F.count("*").alias("n"), *(F.sum(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")).cast("int")).alias(c) for c in columns))


def regressions(now: DataFrame, base: DataFrame, tolerance: dict[str, float]) -> DataFrame:
    """(metric, delta, ok) of named metrics against a baseline; a fall beyond the tolerance isn't ok."""
    allowed = F.create_map(*(F.lit(x) for pair in tolerance.items() for x in pair))
    met = now.select("metric", "value").join(base.select("metric", F.col("value").alias("was")), "metric")
    return met.select("metric", F.round(F.col("value") - F.col("was"), 6).alias("delta"), (F.col("value") - F.col("was") >= -allowed[F.col("metric")] - 1e-12).alias("ok"))


# logs ------------------------------------------------------------------------------------------


def daily_stats(log: DataFrame, last: int = 100) -> DataFrame:
    """(date, total, errors, refusals, avg_seconds, total_seconds, refusal_rate, recent_score) from (ts, seconds, error, refusal, score)."""
    dated = log.withColumn("date", F.to_date("ts"))
    nth = F.row_number().over(Window.partitionBy("date").orderBy(F.col("ts").desc(), F.col("id").desc()))
    recent = F.avg(F.when(F.col("nth") <= last, F.col("score")))
    n = lambda c: F.sum(c.cast("int"))
    sums = dated.withColumn("nth", nth).groupBy("date").agg(F.count("*").alias("total"), n(F.col("error")).alias("errors"), n(F.col("refusal")).alias("refusals"), F.round(F.avg("seconds"), 2).alias("avg_seconds"), F.round(F.sum("seconds"), 2).alias("total_seconds"), F.round(recent, 4).alias("recent_score"))
    return sums.withColumn("refusal_rate", F.round(100 * F.col("refusals") / F.col("total"), 2))


def latency(log: DataFrame) -> DataFrame:
    return log.agg(F.round(F.avg("seconds"), 4).alias("avg"), F.round(F.percentile("seconds", F.lit(0.95)), 4).alias("p95"), F.round(F.max("seconds"), 4).alias("max"))


#: Sketches of latencies: entries a level, and the error in rank that a quantile of them has at most with 99 % certainty.
SKETCH_SIZE, RANK_ERROR = 400, 0.007


def latency_sketches(log: DataFrame, *by: str) -> DataFrame:
    """A mergeable record of a group's seconds: (by, n, total, longest, sketch). Its size doesn't grow with the group."""
    rows = log.where(F.col("seconds").isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("seconds").alias("total"), F.max("seconds").alias("longest"), F.kll_sketch_agg_double("seconds", F.lit(SKETCH_SIZE)).alias("sketch"))


def merged_latency(sketches: DataFrame, *by: str, share: float = 0.95) -> DataFrame:
    """(by, n, avg, max, quantile) of records put together: the quantile's rank is within ``RANK_ERROR`` of the share."""
    whole = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("longest").alias("max"), F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch"))
    return whole.select(*by, "n", (F.col("total") / F.col("n")).alias("avg"), "max", F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("quantile"))


def keyword_hit_rate(answer: Column, keywords: Column) -> Column:
    """The share of expected keywords that an answer has, in any case of letters; 0 without keywords."""
    found = F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k)))
    return F.coalesce(F.try_divide(F.size(found).cast("double"), F.size(keywords)), F.lit(0.0))


# gold chunks, criteria, golden questions --------------------------------------------------------


def answerability(records: DataFrame) -> DataFrame:
    """(answerability, n) of the records that expect a document; those without a label are unlabeled."""
    label = F.coalesce("gold_answerability", F.lit("unlabeled"))
    return records.where(F.coalesce("expected_doc", F.lit("")) != "").groupBy(label.alias("answerability")).agg(F.count("*").alias("n"))


def chunk_level(records: DataFrame) -> DataFrame:
    """One row: the share of records with gold chunks that hit one, and how many questions without support were refused; 0 where there are none."""
    labelled, unsupported = F.coalesce(F.size("gold_chunk_ids") > 0, F.lit(False)), F.coalesce(F.col("gold_answerability") == "unsupported", F.lit(False))
    part = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    hit, refused = part(labelled & F.coalesce("expected_hit", F.lit(False))), part(unsupported & F.coalesce("correct_refusal", F.lit(False)))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return records.agg(ratio(hit, part(labelled)).alias("chunk_hit_rate"), part(unsupported).alias("unsupported"), refused.alias("refused"), F.round(ratio(refused, part(unsupported)), 4).alias("refusal_rate"))


def precision_at_k(hits: DataFrame, ks: DataFrame) -> DataFrame:
    """(k, precision): of each question's first k hits the share of different files, a mean over the questions that have hits. ``ks`` (k) are few."""
    top = hits.join(F.broadcast(ks), F.col("rank") <= F.col("k"))  # a hit goes to as many k as there are
    per = top.groupBy("k", "query_id").agg((F.countDistinct(F.coalesce("filename", F.lit(""))) / F.count("*")).alias("p"))
    return per.groupBy("k").agg(F.avg("p").alias("precision"))


def exit_criteria(m: DataFrame) -> DataFrame:
    """(criterion, ok) of one row of figures: harm, ood, ood_rejected, false_abstain, unnecessary, evidence_recall (of what can be answered), decomposition_success."""
    rules = {"harm": F.col("harm") == 0, "ood_reject": F.col("ood_rejected") == F.col("ood"), "false_abstain": F.col("false_abstain") == 0, "unnecessary": F.col("unnecessary") == 0, "evidence_recall": F.col("evidence_recall") >= 0.8, "decomposition": F.col("decomposition_success") > 0}
    each = F.array(*(F.struct(F.lit(name).alias("criterion"), F.coalesce(ok, F.lit(False)).alias("ok")) for name, ok in rules.items()))
    return m.select(F.inline(each))


def rule_checks(probes: DataFrame) -> DataFrame:
    """(id, category, ok): probes that should be accepted have no sign of several parts, those to be decomposed have one; others aren't checked."""
    from ..functions.text import is_comparison, is_multi_part

    several = is_multi_part(F.col("question")) | is_comparison(F.col("question"))
    return probes.where(F.col("category").isin("accept", "decompose")).select("id", "category", F.when(F.col("category") == "accept", ~several).otherwise(several).alias("ok"))


def golden_hit(expected: Column, filename: Column) -> Column:
    """Whether a file is the expected one: by its name, its name without suffix, or as beginning of what follows the first underscore."""
    base = F.regexp_replace(expected, r"\.[^.]*$", "")
    stem = F.when(base.contains("_"), F.regexp_replace(base, "^[^_]*_", "")).otherwise(base)
    return (F.coalesce(expected, F.lit("")) != "") & ((filename == expected) | (filename == base) | filename.startswith(stem))


def golden_answer(answer: Column, keywords: Column) -> Column:
    """missing_keywords and keyword_hit_rate of an answer, as written; 1 without keywords."""
    missing = F.filter(keywords, lambda k: ~F.contains(answer, k))
    rate = F.when(F.size(keywords) > 0, (F.size(keywords) - F.size(missing)) / F.size(keywords)).otherwise(1.0)
    return F.struct(missing.alias("missing_keywords"), F.round(rate, 2).alias("keyword_hit_rate"))


def stats_view(daily: DataFrame) -> DataFrame:
    """What the statistics page shows of ``daily_stats``."""
    return daily.select("date", F.col("total").alias("total_queries"), (F.col("total") - F.col("errors")).alias("success_count"), F.col("errors").alias("error_count"), F.col("refusals").alias("refusal_count"), "refusal_rate", F.col("avg_seconds").alias("avg_response_time"))
