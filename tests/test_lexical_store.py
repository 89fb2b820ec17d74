"""The stored lexical index: segments, tombstones, merge, pruned scans, snapshots."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import bm25
from docloom.operators.lexical_store import LexicalStore
from docloom.sources.segments import Conflict, Segments

WORDS = "sun moon star rain wind snow fire stone river leaf".split()


def rows(spark, ids, salt=0):
    return spark.createDataFrame([(f"c{i}", " ".join(WORDS[(i * 7 + j * j + salt) % 10] for j in range(3 + i % 9)), i % 3) for i in ids], "chunk_id string, text string, part int")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "sun river sun"), (2, "leaf unheard"), (3, "")], "query_id int, question string")


def found(index, asked):
    return sorted((r.query_id, r.chunk_id, round(r.score, 9), r.rank) for r in bm25.search(index, asked, 5).collect())


def same(store, chunks, asked):
    built = bm25.build(chunks)
    assert found(store, asked) == found(built, asked)
    figures = lambda df: sorted((r.term, r.df, round(r.idf, 9)) for r in df.collect())
    assert figures(store.terms()) == figures(built.terms) and store.count() == chunks.count()


def test_upserts_removals_and_merge_equal_an_index_of_what_is_left(spark, tmp_path, asked):
    store = LexicalStore(spark, f"file://{tmp_path}/ix", buckets=8)
    assert store.count() == 0 and found(store, asked) == [] and store.chunks().count() == 0
    store.remove(rows(spark, [1]))
    store.index(rows(spark, range(60)))
    same(store, rows(spark, range(60)), asked)
    news = rows(spark, range(50, 80), salt=4)
    odd = spark.createDataFrame([(None, "sun", 1), ("", "sun", 1), ("c9", None, 1), ("c8", "", 1)], "chunk_id string, text string, part int")
    store.index(news.unionByName(odd))
    left = rows(spark, range(50)).unionByName(news)
    same(store, left, asked)
    store.remove(rows(spark, [3, 4, 55, 999]))
    left = left.where("chunk_id not in ('c3', 'c4', 'c55')")
    same(store, left, asked)
    store.index(rows(spark, [3], salt=2))  # an id that was removed comes back
    left = left.unionByName(rows(spark, [3], salt=2))
    same(store, left, asked)
    assert len(store.segments.state()["segments"]) == 4
    store.merge()
    assert len(store.segments.state()["segments"]) == 1
    same(store, left, asked)
    assert store.segments.vacuum() == 4
    same(store, left, asked)
    assert sorted(map(tuple, store.chunks().select("chunk_id", "text", "part").collect())) == sorted(map(tuple, left.collect()))
    store.rebuild(rows(spark, range(5)))
    same(store, rows(spark, range(5)), asked)


def test_the_last_of_repeated_ids_counts(spark, tmp_path):
    store = LexicalStore(spark, f"file://{tmp_path}/ix", buckets=2)
    store.index(spark.createDataFrame([("a", "new words", 2), ("a", "old words", 1), ("b", "x", 1)], "chunk_id string, text string, seq int"))
    assert {r.chunk_id: r.text for r in store.chunks().collect()} == {"a": "new words", "b": "x"} and store.count() == 2


def test_an_upsert_leaves_earlier_files_alone(spark, tmp_path):
    store = LexicalStore(spark, f"file://{tmp_path}/ix", buckets=4)
    store.index(rows(spark, range(40)))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    store.index(rows(spark, [1, 2], salt=1))
    store.remove(rows(spark, [7]))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())


def test_a_search_reads_the_asked_terms_buckets_only(spark, tmp_path):
    store = LexicalStore(spark, f"file://{tmp_path}/ix", buckets=16)
    store.index(rows(spark, range(200)))
    held = store.asked(spark.createDataFrame([("sun",)], "term string"))
    plan = held.postings._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(term" in plan.replace("EqualTo(term", "In(term")
    held_all = store.segments.live("postings")
    read = {f.split("bucket=")[1].split("/")[0] for f in held_all.where(F.col("term") == "sun").select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(read) == 1 and len(held_all.inputFiles()) > 4 * 1
    assert held.postings.select("term").distinct().collect()[0].term == "sun"


def test_long_lists_of_asked_terms_are_joined(spark, tmp_path, asked, monkeypatch):
    from docloom.operators import lexical_store

    store = LexicalStore(spark, f"file://{tmp_path}/ix", buckets=4)
    store.index(rows(spark, range(60)))
    few = found(store, asked)
    monkeypatch.setattr(lexical_store, "LISTED", 1)
    assert found(store, asked) == few
    monkeypatch.setattr(bm25, "MOST_TERMS", 2)
    assert found(store, asked) == few


def test_a_writer_that_comes_second_is_told(spark, tmp_path):
    one = Segments(spark, f"file://{tmp_path}/t")
    was, segment = one.state(), one.begin()
    one.put(segment, "docs", rows(spark, [1]))
    one.commit(segment, was)
    late = one.begin()
    one.put(late, "docs", rows(spark, [2]))
    with pytest.raises(Conflict):
        one.commit(late, was)
    assert [r.chunk_id for r in one.live("docs").collect()] == ["c1"]
    (tmp_path / "t/_snapshots/000000000009.json").write_text("{broken")  # a snapshot that can't be read: the one before counts
    (tmp_path / "t/_snapshots/.000000000009.json.crc").unlink(missing_ok=True)
    assert one.state()["version"] == 1


def test_postings_are_written_where_they_are_made(spark, tmp_path, monkeypatch):
    """No bucket of postings comes together in a task: neither an index nor a merge shuffles them."""
    from docloom.sources.segments import Segments

    put, plans = Segments.put, []
    monkeypatch.setattr(Segments, "put", lambda self, segment, part, df, by=(): (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if part == "postings" else None) or put(self, segment, part, df, by))
    store = LexicalStore(spark, f"file://{tmp_path}/ix", buckets=4)
    for text in ("sun moon sun", "moon star"):
        store.index(spark.createDataFrame([(f"c{i}", f"{text} w{i % 7}") for i in range(40)], "chunk_id string, text string"))
    store.merge()
    assert len(plans) == 3 and not any("Repartition" in p for p in plans)
    found = store.asked(spark.createDataFrame([("moon",), ("sun",)], "term string"))
    assert found.postings.count() == 40 and [r.df for r in found.terms.where("term = 'moon'").collect()] == [40]
