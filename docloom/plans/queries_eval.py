"""Queries of evaluation metrics, audits, logs, and of the sources and sinks of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25, evaluation as E
from .queries_index import BM25
from .registry import query
from .tables import chunks, lexical, literal, questions, split_columns, table, with_chunks

# Questions are benchmark items; an item quoted in some document is an exact match with those documents as gold.
_GOLD = r"gold AS (SELECT item_id AS query_id, 'd' || doc_id AS filename FROM benchmark b, documents d WHERE contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')))"
_HITS = f"{BM25}, {_GOLD}, hits AS (SELECT query_id, chunk_id AS id, filename, rank, score FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 10)"
_RECORDS = f"""{_HITS}, hr AS (SELECT h.query_id, min(h.rank) AS hit_rank FROM hits h JOIN gold g ON h.query_id = g.query_id AND h.filename = g.filename GROUP BY 1),
st AS (SELECT query_id, count(DISTINCT filename) AS n_files, count(*) AS num_retrieved, max(score) / (max(score) + 20) AS top_score FROM hits GROUP BY 1),
records AS (SELECT q.query_id, CASE WHEN q.query_id IN (SELECT query_id FROM gold) THEN 'exact_match' ELSE 'out_of_knowledge' END AS category, CASE WHEN length(question) < 180 THEN 'easy' WHEN length(question) < 280 THEN 'medium' ELSE 'hard' END AS difficulty,
 hit_rank, top_score < 0.7 AS is_refusal, (top_score < 0.7) = (q.query_id NOT IN (SELECT query_id FROM gold)) AS correct_refusal, n_files, num_retrieved, top_score, length(question) / 100.0 AS seconds FROM questions q LEFT JOIN hr USING (query_id) LEFT JOIN st USING (query_id))"""


def _hits(spark, sf_dir, k=10):
    source = chunks(spark, sf_dir)
    found = bm25.search(lexical(spark, sf_dir), questions(spark, sf_dir), k)
    return with_chunks(found.withColumnRenamed("chunk_id", "id"), source.select("chunk_id", "filename"))


def _gold(spark, sf_dir):
    from ..operators.containment import gold_lookup

    found = gold_lookup(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("sentence")), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.where("how = 'exact'").select(F.col("item_id").alias("query_id"), F.concat(F.lit("d"), F.col("doc_id")).alias("filename"))


def _records(spark, sf_dir):
    asked, hits, gold = questions(spark, sf_dir), _hits(spark, sf_dir), _gold(spark, sf_dir)
    stats = hits.groupBy("query_id").agg(F.countDistinct("filename").alias("n_files"), F.count("*").alias("num_retrieved"), (F.max("score") / (F.max("score") + 20)).alias("top_score"))
    known = gold.select("query_id").distinct().withColumn("known", F.lit(True))
    rows = asked.join(E.hit_ranks(hits, gold), "query_id", "left").join(stats, "query_id", "left").join(known, "query_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    n = F.length("question")
    return rows.select(
        "query_id", F.when(F.col("known"), "exact_match").otherwise("out_of_knowledge").alias("category"), F.when(n < 180, "easy").when(n < 280, "medium").otherwise("hard").alias("difficulty"),
        "hit_rank", (F.col("top_score") < 0.7).alias("is_refusal"), ((F.col("top_score") < 0.7) == ~F.col("known")).alias("correct_refusal"), "n_files", "num_retrieved", "top_score", (n / 100.0).alias("seconds"),
    )


@query("e2_hit_rank", f"{_RECORDS} SELECT query_id, hit_rank FROM records")
def hit_rank(spark, sf_dir):
    return _records(spark, sf_dir).select("query_id", "hit_rank")


_ALL = """SELECT coalesce(category, '*') AS category, coalesce(difficulty, '*') AS difficulty, count(*) AS n,
 coalesce(avg(CASE WHEN category_ = 'exact_match' THEN CAST(hit_rank IS NOT NULL AS INT) END), 0) AS hit_rate, coalesce(avg(CASE WHEN category_ = 'exact_match' THEN coalesce(1.0 / hit_rank, 0) END), 0) AS mrr,
 coalesce(avg(CASE WHEN category_ = 'exact_match' THEN CASE WHEN hit_rank <= 5 THEN 1 / log2(hit_rank + 1.0) ELSE 0 END END), 0) AS ndcg, avg(CAST(correct_refusal AS INT)) AS refusal_accuracy,
 sum(CASE WHEN category_ = 'out_of_knowledge' AND correct_refusal THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN category_ = 'out_of_knowledge' AND NOT correct_refusal THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN category_ <> 'out_of_knowledge' AND NOT correct_refusal AND is_refusal THEN 1 ELSE 0 END) AS fp,
 coalesce(avg(CASE WHEN category_ = 'out_of_knowledge' THEN CAST(NOT correct_refusal AS INT) END), 0) AS fpr, coalesce(avg(CASE WHEN num_retrieved > 0 THEN n_files END), 0) AS diversity, coalesce(avg(CASE WHEN top_score > 0 THEN top_score END), 0) AS semantic, avg(CAST(seconds AS DOUBLE)) AS secs
 FROM (SELECT *, category AS category_ FROM records) GROUP BY GROUPING SETS ((), (category), (difficulty))"""


@query("e10_metrics", f"{_RECORDS}, m AS ({_ALL}), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM m) SELECT category, difficulty, n, round(CAST(hit_rate AS DOUBLE), 4) AS hit_rate, round(CAST(mrr AS DOUBLE), 4) AS mrr, round(CAST(ndcg AS DOUBLE), 4) AS ndcg, round(CAST(refusal_accuracy AS DOUBLE), 4) AS refusal_accuracy, round(CAST(pr AS DOUBLE), 4) AS \"precision\", round(CAST(rc AS DOUBLE), 4) AS recall, round(CAST(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS DOUBLE), 4) AS f1, round(CAST(fpr AS DOUBLE), 4) AS false_positive_rate, round(CAST(diversity AS DOUBLE), 2) AS passage_diversity, round(CAST(semantic AS DOUBLE), 4) AS semantic_score, round(secs, 2) AS avg_seconds FROM p")
def metrics(spark, sf_dir):
    """E1 and E3 to E10, over all, by category and by difficulty in one pass."""
    return E.metrics(_records(spark, sf_dir))


@query("e11_recall_at_k", f"{_HITS} SELECT k, round(CAST(avg(r) AS DOUBLE), 4) AS recall FROM (SELECT k, g.query_id, max(CASE WHEN h.rank <= k THEN 1 ELSE 0 END) AS r FROM (VALUES (1), (3), (5), (10)) AS t(k), gold g LEFT JOIN hits h ON h.query_id = g.query_id AND h.filename = g.filename GROUP BY 1, 2) GROUP BY k")
def recall_at_k(spark, sf_dir):
    found = _gold(spark, sf_dir).join(_hits(spark, sf_dir), ["query_id", "filename"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    ks = literal(spark, "k", "(1), (3), (5), (10)")
    return found.join(F.broadcast(ks)).groupBy("k").agg(F.round(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))), 4).alias("recall"))


_PAIRS = "(1, false, true, false, true), (2, true, false, true, true), (3, true, true, true, true), (4, false, false, false, true), (5, false, false, false, false)"


@query("e15_evidence", f"{_HITS}, g AS (SELECT query_id, filename AS id, 1 + row_number() OVER (PARTITION BY query_id ORDER BY filename) % 2 AS hop FROM gold), t AS (SELECT DISTINCT query_id, filename AS id FROM hits WHERE rank <= 5), i AS (SELECT g.query_id, g.hop, g.id, t.id IS NOT NULL AS f FROM g LEFT JOIN t USING (query_id, id)), r AS (SELECT query_id, avg(CAST(f AS INT)) AS er FROM i GROUP BY 1), h AS (SELECT query_id, avg(CAST(f AS INT)) AS hr FROM (SELECT query_id, hop, bool_or(f) AS f FROM i GROUP BY 1, 2) GROUP BY 1) SELECT query_id, round(er, 6) AS evidence_recall, round(hr, 6) AS hop_recall FROM r JOIN h USING (query_id)")
def evidence(spark, sf_dir):
    from pyspark.sql import Window

    gold = _gold(spark, sf_dir).withColumn("hop", 1 + F.row_number().over(Window.partitionBy("query_id").orderBy("filename")) % 2).withColumnRenamed("filename", "id")
    hits = _hits(spark, sf_dir).select("query_id", F.col("filename").alias("id"), "rank")
    found = E.evidence_metrics(gold, hits)
    return found.select("query_id", F.round("evidence_recall", 6).alias("evidence_recall"), F.round("hop_recall", 6).alias("hop_recall"))


@query("e20_cross_document", f"{_HITS}, f AS (SELECT query_id, filename, min(rank) AS rank FROM hits WHERE rank <= 8 GROUP BY 1, 2), p AS (SELECT g.query_id, count(*) AS n, count(rank) AS got, min(rank) AS first FROM (SELECT DISTINCT * FROM gold) g LEFT JOIN f USING (query_id, filename) GROUP BY 1) SELECT round(avg(got / n), 4) AS doc_recall, round(avg(got), 4) AS coverage, round(avg(coalesce(1 / first, 0)), 4) AS mrr, round(avg(CAST(got = n AS INT)), 4) AS full_coverage, round(avg(CAST(got > 0 AS INT)), 4) AS at_least_one FROM p")
def cross_document(spark, sf_dir):
    return E.cross_document(_gold(spark, sf_dir), _hits(spark, sf_dir))


# Every event is a route: expected and actual as comma lists, outcomes from the event.
_ROUTE = """event_id AS id, CASE event_type WHEN 'view' THEN 'easy_single_hop' WHEN 'click' THEN 'multi_hop_composition' WHEN 'error' THEN 'unsupported_ood' ELSE 'comparison' END AS type,
 CASE event_id % 6 WHEN 0 THEN 'RETRIEVE,ACCEPT' WHEN 1 THEN 'RETRIEVE,RETRIEVE,ACCEPT' WHEN 2 THEN 'DECOMPOSE,ACCEPT' WHEN 3 THEN 'RETRIEVE,DECOMPOSE,ACCEPT' WHEN 4 THEN 'RETRIEVE,ABSTAIN' ELSE 'RETRIEVE,RETRIEVE,ABSTAIN' END AS r,
 CASE user_id % 4 WHEN 0 THEN 'RETRIEVE,ACCEPT' WHEN 1 THEN 'RETRIEVE,DECOMPOSE,ACCEPT' WHEN 2 THEN '' ELSE 'RETRIEVE,ABSTAIN' END AS x, value > 8 AS hit, event_id % 6 >= 4 AS abstained, round(least(value, 20) / 20, 2) AS er, CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0.5 END AS hop, event_id % 7 <> 0 AS answer_ok"""
_R = f"WITH t AS (SELECT {_ROUTE} FROM events)" + """, a AS (SELECT *, string_split(r, ',') AS route, CASE WHEN x = '' THEN [] ELSE string_split(x, ',') END AS expected FROM t),
b AS (SELECT *, list_filter(route[2:len(route) - 1], lambda s: s IN ('RETRIEVE', 'DECOMPOSE')) AS inner_ FROM a),
c AS (SELECT *, CASE WHEN len(expected) = 0 THEN route[-1] = 'ABSTAIN' WHEN route[-1] <> expected[-1] THEN false WHEN route[-1] = 'ABSTAIN' THEN true WHEN len(expected) = 2 THEN len(inner_) = 0 ELSE len(inner_) > 0 OR (route[1] = 'DECOMPOSE' AND len(route) >= 2) END AS policy_ok,
 type = 'easy_single_hop' AND len(inner_) > 0 AS unnecessary, list_contains(inner_, 'RETRIEVE') AND route[-1] = 'ACCEPT' AND hit AS retry_recovery, list_contains(route, 'DECOMPOSE') AND route[-1] = 'ACCEPT' AND hit AS decomposition_success FROM b)"""


def _routes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(*split_columns(_ROUTE))
    return rows.select("id", "type", F.split("r", ",").alias("route"), F.when(F.col("x") == "", F.array().cast("array<string>")).otherwise(F.split("x", ",")).alias("expected_route"), "hit", "abstained", F.col("er").cast("double").alias("evidence_recall"), F.col("hop").cast("double").alias("hop_recall"), "answer_ok")


@query("e16_routes", f"{_R} SELECT id, policy_ok, unnecessary, retry_recovery, decomposition_success FROM c")
def routes(spark, sf_dir):
    return E.route_metrics(_routes(spark, sf_dir)).select("id", "policy_ok", "unnecessary", "retry_recovery", "decomposition_success")


@query("e18_capability", f"{_R} SELECT coalesce(type, '*') AS type, count(*) AS n, round(avg(CAST(er AS DOUBLE)), 3) AS evidence_recall, round(avg(CAST(hop AS DOUBLE)), 3) AS hop_recall, sum(CAST(policy_ok AS INT)) AS policy_ok, sum(CAST(unnecessary AS INT)) AS unnecessary, sum(CAST(retry_recovery AS INT)) AS retry_recovery, sum(CAST(decomposition_success AS INT)) AS decomposition_success, sum(CAST(answer_ok AS INT)) AS answer_ok, count(*) FILTER (type_ = 'unsupported_ood' AND abstained) AS ood_reject, count(*) FILTER (type_ <> 'unsupported_ood' AND abstained) AS false_abstain FROM (SELECT *, type AS type_ FROM c) GROUP BY GROUPING SETS ((), (type))")
def capability(spark, sf_dir):
    return E.capability(E.route_metrics(_routes(spark, sf_dir)))


@query("e21_failure_surfaces", f"{_R}, e AS (SELECT *, abstained <> (len(expected) = 0 OR coalesce(expected[-1] = 'ABSTAIN', false)) AS refusal, len(expected) > 0 AND coalesce(route[-1] = expected[-1], false) AND NOT policy_ok AS policy_, NOT abstained AND er < 1.0 AS retrieval FROM c) SELECT id, list_filter([CASE WHEN refusal THEN 'refusal' END, CASE WHEN policy_ THEN 'policy' END, CASE WHEN retrieval THEN 'retrieval' END, CASE WHEN NOT abstained AND NOT answer_ok AND NOT refusal AND NOT policy_ AND NOT retrieval THEN 'generation' END], lambda s: s IS NOT NULL) AS surfaces FROM e")
def failure_surfaces(spark, sf_dir):
    return E.failure_surfaces(_routes(spark, sf_dir))


_BAD = """
 ('b1', '2026-01-02', 'p', 'e', 'r', 'f', 'v', 'closed'), ('b2', '2026-1-2', 'p', 'e', 'r', 'f', 'v', 'open'), ('b3', '2026-01-02', '', 'e', 'r', 'f', 'v', 'odd'),
 ('b4', '2026-01-02', 'p', 'e', 'r', '', 'v', 'closed'), ('b1', '2026-01-03', 'p', 'e', 'r', 'f', 'v', 'fixing')"""
_BCOLS = "id, discovered, problem, expected_behavior, root_cause, fix, verification, status"


_NOW = "('evidence_recall', 0.88), ('policy_action_accuracy', 0.7), ('ood_reject', 1.0)"
_BASE = "('evidence_recall', 0.89), ('policy_action_accuracy', 0.8), ('ood_reject', 1.0)"
_TOLERANCE = {"evidence_recall": 0.02, "policy_action_accuracy": 0.0, "ood_reject": 0.0}


# logs: events are query log entries ------------------------------------------------------------


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("value").alias("seconds"), (F.col("event_type") == "error").alias("error"), (F.col("event_type") == "view").alias("refusal"), (F.col("value") / 100).alias("score"))


@query("e27_daily_stats", "WITH e AS (SELECT event_id AS id, ts, CAST(ts AS DATE) AS date, value AS seconds, event_type = 'error' AS error, event_type = 'view' AS refusal, value / 100 AS score, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS nth FROM events) SELECT date, count(*) AS total, sum(CAST(error AS INT)) AS errors, sum(CAST(refusal AS INT)) AS refusals, round(avg(seconds), 2) AS avg_seconds, round(sum(seconds), 2) AS total_seconds, round(avg(CASE WHEN nth <= 100 THEN score END), 4) AS recent_score, round(100 * sum(CAST(refusal AS INT)) / count(*), 2) AS refusal_rate FROM e GROUP BY date")
def daily_stats(spark, sf_dir):
    return E.daily_stats(_log(spark, sf_dir))


@query("e29_latency", "SELECT round(avg(value), 4) AS avg, round(quantile_cont(value, 0.95), 4) AS p95, round(max(value), 4) AS max FROM events")
def latency(spark, sf_dir):
    return E.latency(_log(spark, sf_dir))


@query("e29_latency_days", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg, round(max(value), 4) AS max, true AS within FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_days(spark, sf_dir):
    """Each event type's p95 from sketches of its days; whether its true rank is within the stated error is counted over all events."""
    log = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("date"), F.col("value").alias("seconds"))
    found = E.merged_latency(E.latency_sketches(log, "event_type", "date"), "event_type")
    less = log.join(F.broadcast(found.select("event_type", "quantile")), "event_type").groupBy("event_type").agg(F.avg((F.col("seconds") < F.col("quantile")).cast("double")).alias("below"), F.avg((F.col("seconds") <= F.col("quantile")).cast("double")).alias("upto"))
    within = (F.col("below") <= 0.95 + E.RANK_ERROR) & (F.col("upto") >= 0.95 - E.RANK_ERROR)
    return found.join(less, "event_type").select("event_type", "n", F.round("avg", 4).alias("avg"), F.round("max", 4).alias("max"), within.alias("within"))


@query("s13_log_sink", "SELECT event_type, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS seconds, max(value) AS longest, count(*) AS entries, sum(length(substr(props, 1, 200))) AS characters FROM events GROUP BY event_type")
def log_sink(spark, sf_dir):
    """Events go through the sink as a stream, and the stream once more from its start: entries and statistics are those of one."""
    from ..operators.storage import shared_path
    from ..streaming.log_sink import LogSink

    # a pattern, as the table may be a file or a folder
    kind, path = table(spark, sf_dir, "events").schema, f"{sf_dir}/events.parque[t]"
    sink = LogSink(spark, shared_path(spark, "log"))
    for _ in range(2):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(path)
        sink.write("events", stream.select(F.col("event_id").alias("id"), "ts", "event_type", F.col("value").alias("seconds"), F.col("props").alias("text")), shared_path(spark, "log-state"))
    entries = sink.entries().groupBy("event_type").agg(F.count("*").alias("entries"), F.sum(F.length("text")).alias("characters"))
    return sink.stats().join(entries, "event_type").select("event_type", "total", "errors", F.round("seconds", 4).alias("seconds"), "longest", "entries", "characters")


@query("s14_recent_queries", "SELECT event_id, substr(props, 1, 200) AS preview FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent(spark, sf_dir):
    """A report of the last twenty log entries."""
    return table(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20).select("event_id", F.substring("props", 1, 200).alias("preview"))


@query("s13_log_round_trip", "SELECT conv_id, turn, text AS question, false AS is_refusal FROM conversations WHERE role = 'user'")
def log_round_trip(spark, sf_dir):
    """Log entries written as JSON lines and read back; malformed lines are dropped."""
    from ..sources import records

    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("key"), F.col("text").alias("question"))
    return records.log_round_trip(spark, rows).select("key.conv_id", "key.turn", "question", "is_refusal")


@query("s15_feedback_round_trip", "SELECT conv_id AS id, text AS question, turn % 2 AS rating, substr(text, 1, 100) AS reason FROM conversations WHERE role = 'user'")
def feedback_round_trip(spark, sf_dir):
    """Feedback written as CSV with a header and read back."""
    from ..sources import records

    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("id"), F.col("text").alias("question"), (F.col("turn") % 2).alias("rating"), F.substring("text", 1, 100).alias("reason"))
    return records.feedback_round_trip(spark, rows)


@query("s18_golden", "SELECT item_id AS id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty FROM benchmark WHERE item_id % 2 = 0")
def golden(spark, sf_dir):
    """Golden questions written as JSON, read back, filtered by difficulty."""
    from ..sources import records

    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.when(F.col("item_id") % 2 == 0, "easy").otherwise("hard").alias("difficulty"))
    return records.golden_round_trip(spark, rows).where("difficulty = 'easy'")
