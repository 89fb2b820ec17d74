"""Containment, score store, collections, semantic cache and served retrieval, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import bm25, caches, containment, fusion, retrieval, vectors as V
from docloom.operators.score_store import ScoreStore
from docloom.sources.collections import Collections, numbered, with_tags


def solid(t):
    return "".join(c for c in t if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("block", [10**6, 40])
def test_gold_lookup_equals_a_nested_loop(spark, monkeypatch, block):
    monkeypatch.setattr(containment, "BLOCK_CHARS", block)
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("ab ba cc dd é".split()) for _ in range(n))
    sentences = [(i, line(rng.randrange(3, 40))) for i in range(40)] + [(100, ""), (101, None), (102, "zz"), (103, "a"), (104, "a")]
    docs = [(i, line(60) + "\n" + (sentences[i % 40][1] if i % 2 else sentences[i % 40][1][:60])) for i in range(60)] + [(900, None), (901, ""), (902, "  ")]
    want = set()
    for i, s in sentences:
        if s is None:
            continue
        exact = {(i, d, "exact") for d, t in docs if t is not None and solid(s) in solid(t)}
        head = solid(s)[:30]
        want |= exact or {(i, d, "prefix") for d, t in docs if t is not None and len(head) >= 8 and head in solid(t)}
    found = containment.gold_lookup(spark.createDataFrame(sentences, "item_id int, sentence string"), spark.createDataFrame(docs, "doc_id int, text string").repartition(5)).collect()
    assert sorted(map(tuple, found)) == sorted(want) and {h for _, _, h in want} == {"exact", "prefix"}
    assert containment.gold_lookup(spark.createDataFrame([], "item_id int, sentence string"), spark.createDataFrame(docs, "doc_id int, text string")).count() == 0


def test_pairs_are_scored_once(spark, tmp_path):
    store = ScoreStore(spark, f"file://{tmp_path}/s", lambda asked, texts: [float(len(a) + len(t)) for a, t in zip(asked, texts, strict=True)])
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, id string, question string, text string, rank int")
    first = [(1, "a", "qq", "xx", 1), (1, "b", "qq", "xxxx", 2), (2, "a", "qq", "xx", 1), (3, "c", None, "x", 1)]
    found = sorted((r.query_id, r.id, r.rerank_score) for r in store.scored(hits(first)).collect())
    assert found == [(1, "a", 4.0), (1, "b", 6.0), (2, "a", 4.0), (3, "c", None)] and store.count() == 2
    again = store.scored(hits([*first, (4, "b", "qqq", "xxxx", 1)]))
    assert again.count() == 5 and store.count() == 3
    assert again.where("query_id = 4").first().rerank_score == 7.0
    store.scored(hits(first))
    assert store.count() == 3 and len(store.segments.state()["segments"]) == 2
    best = store.reranked(hits(first), 1)
    assert sorted((r.query_id, r.id) for r in best.collect()) == [(1, "b"), (2, "a"), (3, "c")]


def test_collections_upsert_report_and_snapshots(spark, tmp_path):
    c = Collections(spark, f"file://{tmp_path}/kb")
    c.create("x", ["t"], "m", 2)
    rows = [("a", "one", [1.0, 2.0], 1, 0), ("b", "two", [1.0, 2.0], 1, 1), (None, "three", [0.0, 0.0], 1, 2), ("a", "four", [1.0, 1.0], 2, 0), ("c", "bad", [1.0], 3, 0), ("d", "lost", [1.0, 1.0], 3, 1), ("e", None, [1.0, 1.0], 4, 0)]
    report = c.add_chunks("x", spark.createDataFrame(rows, "chunk_id string, text string, embedding array<double>, batch int, place int"))
    assert sorted(map(tuple, report.collect())) == [(1, 3, None), (2, 1, None), (3, 2, "dimension"), (4, 1, "no text")]
    texts = lambda: {r.chunk_id: r.text for r in c.chunks("x").collect()}
    assert texts() == {"a": "four", "b": "two", "chunk_2": "three"}
    c.add_chunks("x", spark.createDataFrame([("b", "new", [3.0, 3.0], "extra")], "chunk_id string, text string, embedding array<double>, note string"))
    c.remove_chunks("x", spark.createDataFrame([("a",)], "chunk_id string"))
    assert texts() == {"b": "new", "chunk_2": "three"} and c.count("x") == 2
    assert c.bump_version("x") == 2 and c.get("x")["tags"] == ["t"] and c.count("x") == 2
    c.compact("x")
    assert texts() == {"b": "new", "chunk_2": "three"} and len(c._at("x").state()["segments"]) == 1
    assert [r.name for r in with_tags(c.list(), ["t", "u"]).collect()] == ["x"] and with_tags(c.list(), ["u"]).count() == 0
    with pytest.raises(KeyError):
        c.get("none")
    with pytest.raises(ValueError):
        c.create("a/b")
    none = c.add_chunks("x", spark.createDataFrame([], "chunk_id string, text string"))
    assert none.count() == 0 and c.count("x") == 2


def test_batches_of_a_hundred(spark):
    rows = numbered(spark.range(1050).select(F.format_string("%05d", "id").alias("chunk_id")).repartition(3), "chunk_id")
    sizes = [r["count"] for r in rows.groupBy("batch").count().collect()]
    assert sum(sizes) == 1050 and max(sizes) == 100


@pytest.mark.parametrize("block", [2_000, 7])
def test_semantic_cache_equals_a_nested_loop(spark, monkeypatch, block):
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 8))
    entries = [(f"k{i:03}", float(i % 7) if i % 11 else None, (middle[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(200)]
    asked = [(i, (middle[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(30)] + [(99, [0.0] * 8), (100, None)]
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-10)
    want = {}
    for q, x in asked:
        near = [(at is not None, at, k) for k, at, e in entries if x is not None and cos(x, e) >= 0.85]
        if near:
            want[q] = min(near)[2]
    found = caches.semantic(spark.createDataFrame(asked, "query_id int, embedding array<double>"), spark.createDataFrame(entries, "key string, inserted_at double, embedding array<double>").repartition(4))
    assert {r.query_id: r.key for r in found.collect()} == want and len(want) > 20
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()


QUESTION = "what about sun and river tonight"


@pytest.mark.parametrize(("reply", "texts", "ood"), [(None, [QUESTION], False), ("1. sun river\n2) stone leaf", [QUESTION, "sun river", "stone leaf"], False), (QUESTION, [QUESTION], True), (f"{QUESTION}\nsun river", [QUESTION, "sun river"], False), ("[LLM 不可用] sorry", [QUESTION], False)])
def test_what_is_searched(spark, reply, texts, ood):
    rows = retrieval.rewritten(spark.createDataFrame([(1, QUESTION)], "query_id int, question string"), spark.createDataFrame([(1, reply)], "query_id int, reply string")).orderBy("variant").collect()
    assert [r.text for r in rows] == texts and {r.out_of_domain for r in rows} == {ood}


def test_served_retrieval(spark):
    words = "sun moon star rain wind snow fire stone river leaf".split()
    docs = [(f"c{i}", f"f{i // 3}", " ".join(words[(i + j) % 10] for j in range(3))) for i in range(30)]
    chunks = spark.createDataFrame(docs, "chunk_id string, filename string, text string")
    vectors = spark.createDataFrame([(c, [float(i), 1.0]) for i, (c, _, _) in enumerate(docs)], "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, QUESTION), (2, "leaf")], "query_id int, question string")
    embed = lambda t: t.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    alone = retrieval.served(chunks, vectors, asked, embed, 4).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in alone)[:4] == [(1, 1, "c29"), (1, 2, "c28"), (1, 3, "c26"), (1, 4, "c25")] and {r.out_of_domain for r in alone} == {None}
    replies = spark.createDataFrame([(1, "1. stone river leaf"), (2, "never asked for")], "query_id int, reply string")
    with_model = retrieval.served(chunks, vectors, asked, embed, 4, replies, index=bm25.build(chunks), scorer=fusion.lexical_scorer).collect()
    assert {(r.query_id, r.out_of_domain) for r in with_model} == {(1, False), (2, None)} and len(with_model) == 8
    best = {r.id: r["rank"] for r in with_model if r.query_id == 2}
    assert "leaf" in dict((c, t) for c, _, t in docs)[min(best, key=best.get)]
