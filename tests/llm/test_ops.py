"""Every operator's query and the pipeline, on small folders with odd rows, and on empty tables."""

import sys
import zlib

import pytest
from words import edited, prose

import corpus_pipeline
from docloom.llm import castore, decontam, mixing, probmin, quality, queries
from docloom.llm.common import label_bucket, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed int, node string, size int, row int, bucket long, __id int"
ITEM = prose(77, 30)


def rows():
    good = [(i, prose(i, 60)) for i in range(40)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(i, 40).split())) for i in range(20)]
    copies = [(200 + i, edited(prose(500, 150), i % 3, seed=i)) for i in range(6)] + [(210, prose(1, 60)), (1, prose(1, 60))]
    tainted = [(300, prose(301, 80) + " " + ITEM + " " + prose(302, 80))]
    odd = [(400, None), (401, ""), (402, "one two"), (None, prose(9, 40)), (None, None), (403, prose(6, 30_000)), (404, "a\n\nb\na"), (405, "card 4111 1111 1111 1111 at jo@x.example")]
    return good + bad + copies + tainted + odd


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame([(d, t, "en", (None, "a", "b", "c")[i % 4], 1, 1, "x", 2, 3, 4, 5) for i, (d, t) in enumerate(rows())], DOCS).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d < 100), 0) for d, _ in rows() if d is not None and d < 200] + [(None, 1, 0), (5, None, None), (999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "zz yy xx ww vv uu")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<p>One, two. Three.</p>", "x"), (1, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string").write.parquet(f"{path}/pages.parquet")
    vectors = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [0.0, 3.0, 1.0]), (2, [4.0, -1.0, 2.0]), (3, [0.5, 0.0, 7.0]), (4, None), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]), (7, [float("inf"), 0.0, 0.0]), (8, [1.0]), (9, [])]
    spark.createDataFrame([(*v, 1, 2, 3) for v in vectors], "vec_id long, embedding array<float>, label int, n long, __x int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('none')}"
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        table(spark, folder, name).limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_on_odd_and_empty_tables(spark, folder, empty, name):
    query = queries.queries()[name]
    found = query(spark, folder).collect()
    assert len(found) == {"op3_html": 3, "op9_decontam": 1, "op13_whitening": 5 * 3}.get(name, len(rows()))
    none = query(spark, empty)
    assert none.count() == 0 and none.columns == query(spark, folder).columns


def test_labels_of_held_out_rows_are_never_seen(spark, folder, tmp_path):
    """Turning round the labels of all held-out rows changes no score."""
    path = f"file://{tmp_path}"
    labels = table(spark, folder, "labels")
    labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "toxic").write.parquet(f"{path}/labels.parquet")
    table(spark, folder, "documents").write.parquet(f"{path}/documents.parquet")
    one, two = (sorted(map(str, queries.op2_quality(spark, p).collect())) for p in (folder, path))
    assert one == two
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _ in rows() if d is not None}
    assert all(r.held_out == held[r.doc_id] for r in queries.op2_quality(spark, folder).collect() if r.doc_id is not None)


def test_pipeline_stages_apply_their_operators(spark, folder):
    docs = table(spark, folder, "documents")
    labels, items = table(spark, folder, "labels"), table(spark, folder, "benchmark")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))

    def through(name, df, path=[]):  # noqa: B006
        path.append(f"{folder}/stage-{name}")
        dict(corpus_pipeline.STAGES)[name](spark, df, folder).write.parquet(path[-1])
        return spark.read.parquet(path[-1])

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "token_store"]
    good = through("quality", docs)
    weights = quality.train(docs, labels.where(label_bucket("doc_id") != 0))
    keep = {r.text for r in docs.collect() if quality.score_texts([r.text], weights, 18)[0] >= 0.3}
    assert sorted(map(str, good.collect())) == sorted(str(r) for r in docs.collect() if r.text in keep)
    distinct = through("near_dedup", good)
    classes = {}
    for r in probmin.classes(good).collect():
        classes.setdefault(r.class_id, []).append(r.doc_id)
    assert distinct.columns == docs.columns and distinct.count() <= good.count()
    ids = [r.doc_id for r in distinct.collect()]
    assert sum(d in range(200, 206) for d in ids) <= 1 and len([d for d in ids if d in (1, 210)]) <= 1
    clean = through("decontamination", distinct)
    assert 300 not in [r.doc_id for r in clean.collect()] and same(clean, decontam.clean(distinct, items))
    mix = through("mixing", clean)
    assert mix.columns == docs.columns and same(mix, mixing.mixed(clean))
    stored = through("token_store", mix)
    assert same(stored, castore.stored(mix)) and stored.count() == mix.count()
    assert same(corpus_pipeline.run(spark, folder), stored)


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_the_rest_does_not_need_this_subpackage():
    before = set(sys.modules)
    import docloom.plans.catalog  # noqa: F401

    assert not [m for m in set(sys.modules) - before if m.startswith("docloom.llm")]
