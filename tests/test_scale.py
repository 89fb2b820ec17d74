"""What must not be shuffled or compared pair by pair, and that the results stay those of the plain way."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import bm25

WORDS = "sun moon star rain wind snow fire stone river leaf".split()


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(f"c{i}", " ".join(WORDS[(i * 7 + j * j) % 10] for j in range(i % 9))) for i in range(120)], "chunk_id string, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "sun river sun"), (2, "leaf unheard"), (3, ""), (4, "unheard"), (None, "sun")], "query_id int, question string")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_totals_are_those_of_all_scores_and_hand_on_a_row_a_query_and_task(spark, lines, asked):
    index = bm25.build_stored(lines)
    pairs = bm25.score(index, asked.where("query_id is not null")).groupBy("query_id").agg(F.count("*"), F.round(F.sum("score"), 9), F.round(F.max("score"), 9))
    found = bm25.totals(index, asked)
    assert sorted(map(tuple, found.select("query_id", "chunks", F.round("total", 9), F.round("best", 9)).collect())) == sorted(map(tuple, pairs.collect()))
    assert "Join" not in plan(found) and "collect_list" not in plan(found)


def test_chunks_that_lie_whole_are_searched_without_a_shuffle_of_postings(spark, lines, asked):
    index, plain = bm25.build_stored(lines), bm25.build(lines)
    rows = lambda df: sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in df.collect())
    found = bm25.best(index, asked, 5)
    assert "Aggregate" not in plan(found) and "Join" not in plan(found)
    apart = bm25.Asked(plain.terms, plain.postings(spark.createDataFrame([(w,) for w in WORDS], "term string")), plain.corpus)
    assert rows(found) == rows(bm25.best(type("Apart", (), {"asked": lambda self, terms: apart})(), asked, 5)) and found.count() > 5
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, plain.terms.collect()))


def test_mean_cosines_add_vectors_up_and_are_those_of_all_pairs(spark):
    from docloom.operators import vectors as V

    rows = [(i, i % 3 if i % 7 else None, [float((i * k) % 5 - 2) for k in range(1, 4)]) for i in range(30)] + [(4, 1, [1.0, 0.0, 0.0]), (50, 1, None)]
    vectors = spark.createDataFrame(rows, "vec_id int, domain int, embedding array<double>")
    asked = vectors.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("domain").alias("asked"))
    found = V.mean_cosines(vectors, asked)
    pairs = vectors.where("embedding is not null").join(asked.where("embedding is not null").select("query_id", F.col("embedding").alias("query")), F.col("vec_id") != F.col("query_id"))
    plain = pairs.groupBy("query_id").agg(F.avg(V.cosine(F.col("embedding"), F.col("query"))).alias("mean"))
    rounded = lambda df: sorted((r[0], round(r[1], 8) + 0.0) for r in df.collect())
    assert rounded(found) == rounded(plain) and V.mean_cosines(vectors.limit(0), asked).count() == 0

    near = V.search(vectors, asked, 3, same=("domain", "asked"))
    met = V.scored(vectors.where("embedding is not null"), asked.where("embedding is not null")).where("domain = asked").withColumn("rank", F.row_number().over(V.order_by("query_id", "vec_id"))).where("rank <= 3")
    kept = lambda df: sorted((r.query_id, r.vec_id, round(r.score, 9), r["rank"]) for r in df.where("query_id <> 4").collect())
    assert kept(near) == kept(met.select("query_id", "vec_id", "score", "rank")) and "NestedLoop" not in near._jdf.queryExecution().toString()


def test_upper_case_keeps_the_length_as_sql_does(spark):
    import duckdb

    from docloom.functions import text as X

    texts = ["chß ", "ﬁx ŉ ǰ", "aé 𝔸z", "ᾳ ᾀ", "", None, "\x00\n ıñ"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.upper(F.col("t"))).collect()]
    assert found == [duckdb.execute("SELECT upper(?::VARCHAR)", [t]).fetchone()[0] for t in texts]


def test_folds_over_a_document_see_what_windows_over_lines_give(spark):
    from docloom.operators import chunking

    texts = ["# a\nb\n c \n\nd\n## \n##  e f \r\n#x\ny", "\n\n", "", "plain", "x\ny\n###t\n### t\x0b\n\x85\nz \x85\n#\r q\n# u v", "　# no\n#　no\n# 　\n####  four\na", "# only", "a\r\n\r\nb\x1c\nc"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, None])], "doc string, text string")
    tree = {}
    for r in chunking.section_tree(docs).orderBy("nth").collect():
        tree.setdefault(r.doc, []).append((r.level, r.section, r.text, r.heading))
    runs = {}
    for r in chunking.paragraphs(docs).orderBy("nth").collect():
        runs.setdefault(r.doc, []).append(r.text)
    for i, t in enumerate(texts):
        assert chunking.section_nodes(t) == tree.get(str(i), []), t
        assert chunking.paragraph_texts(t) == runs.get(str(i), []), t
    sizes = chunking.Sizes(2, 6, 3, 25)
    small, parent, both = chunking.small_chunks(docs, sizes), chunking.parent_chunks(docs, sizes), chunking.linked_chunks(docs, sizes)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(both) == rows(chunking.linked(small, parent.select("chunk_id", "text", "heading"))) and both.count() > 3
    for df in (small, parent, both, chunking.split_documents(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_hits_meet_their_chunks_without_a_shuffle_of_chunks(spark, lines, monkeypatch):
    from docloom.plans import tables

    hits = spark.createDataFrame([(1, "c3", 1), (1, "c4", 2), (2, "c3", 1), (2, "none", 2)], "query_id int, id string, rank int")
    found = tables.with_chunks(hits, lines)
    assert found.columns == ["id", "query_id", "rank", "text"] and "ResolvedHint (strategy=broadcast)" in found._jdf.queryExecution().analyzed().toString()
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = rows(hits.join(lines.withColumnRenamed("chunk_id", "id"), "id"))
    assert rows(found) == plain and len(plain) == 3
    monkeypatch.setattr(tables, "MOST_HITS", 1)
    assert rows(tables.with_chunks(hits, lines)) == plain


def test_pages_of_a_batch_become_python_objects_a_slice_at_a_time(spark, monkeypatch):
    from docloom.functions import pages as P

    texts = ["A Title\nbody text here", None, "", "1. First\n\nSecond line."] * 40
    assert [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1).sortWithinPartitions("i").select(P.headings(F.col("t"))).collect()] == [None if t is None else P.with_headings(t) for t in texts]
    held = {}
    monkeypatch.setattr(P.F, "arrow_udf", lambda kind: lambda run: held.setdefault("run", run) or run)

    class Counted:
        def __init__(self, rows):
            self.rows = rows

        def __len__(self):
            return len(self.rows)

        def slice(self, lo, n):
            return Counted(self.rows[lo : lo + n])

        def to_pylist(self):
            held["most"] = max(held.get("most", 0), len(self.rows))
            return self.rows

    P._column(P.with_headings)  # builds the function that takes a batch
    assert held["run"](Counted(texts)).to_pylist() == [None if t is None else P.with_headings(t) for t in texts] and held["most"] <= P.SLICE


def test_postings_are_counted_without_a_shuffle(spark, lines, tmp_path):
    from docloom.operators.lexical_store import LexicalStore

    store = LexicalStore(spark, f"file://{tmp_path}/ix")
    odd = lines.unionByName(spark.createDataFrame([("e", "")], "chunk_id string, text string")).withColumn("dl", F.size(bm25.tokens(F.col("text"))))
    found = store._postings(odd)
    plain = odd.select("chunk_id", "dl", F.explode(bm25.tokens(F.col("text"))).alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf", "dl")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and "Aggregate" not in plan(found)


def test_cleanup_works_out_its_rules_once_below_a_filter(spark):
    from docloom.functions import text as X
    from docloom.operators import ingest

    texts = ["12\nMETHODS AND DATA\n 一、背景 \nwords of a line here and more of them\n  \n\n\n3", "# Head\nAB CD EF\nbody words and words \x85", "12\n13", "", "\n", "1,2,3,4\nⅠ. x\nDOI: 10.1/x\nENOUGH WORDS \x85 \nplain words \u200bﬁ", None, "a \x85 \nIV. MODEL AND ALL\r\nab\nx" * 9]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, text string")
    last = X.normalized_headings(X.without_footers(X.collapsed_blanks(X.unicode_normalized(F.col("text")))))
    plain = rows.select("doc", last.alias("t")).select("doc", "t", F.round(X.content_ratio(F.col("t")), 3), (X.low_value_share(F.col("t")) < 0.5)).collect()
    found = X.cleanup(rows).select("doc", "cleanup.text", "cleanup.content_ratio", F.element_at("cleanup.trace", 5)["passed"]).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, plain), key=str)
    assert [r[0] for r in rows.where("text is not null").orderBy("doc").select(X.wordy(F.col("text"))).collect()] == [r[0] for r in rows.where("text is not null").orderBy("doc").select(X.count_of(F.col("text"), X.WORDY)).collect()]
    assert ingest.process(rows)._jdf.queryExecution().optimizedPlan().toString().count("200B") == 1


def test_all_small_chunks_of_a_long_document_stay(spark):
    from docloom.operators import chunking, ingest

    body = [f"Paragraph {i:04} of a long text with words enough." for i in range(700)]
    docs = spark.createDataFrame([("d", "\n\n".join(body))], "doc string, text string")
    sizes = chunking.Sizes(20, 60, 30, 250)
    for found in (chunking.small_chunks(docs, sizes).collect(), ingest.process(docs, sizes).collect()):
        found = sorted(found, key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in found] == list(range(1, len(found) + 1)) and len(found) > 200
        assert "\n\n".join(r.text for r in found) == "\n\n".join(body)
