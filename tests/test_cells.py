"""The cell index: recall and bytes read against exact search, upserts, hot cells."""

import numpy as np
import pytest

from docloom.operators import cells, vectors as V

ID = "vec_id long, embedding array<double>"


def clustered(n=6_000, clusters=60, width=24, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, width))
    x = middle[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def tables(spark):
    x = clustered()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], ID).repartition(6).cache()
    asked = rows.where("vec_id % 60 = 0").withColumnRenamed("vec_id", "query_id")
    return rows, asked


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    found = cells.CellIndex(spark, f"file://{tmp_path_factory.mktemp('cells')}/ix")
    found.build(tables[0], nlist=32)
    return found


def test_recall_and_bytes_read(tables, index):
    rows, asked = tables
    exact = pairs(V.search(rows, asked, 10))
    found = pairs(index.search(asked, 10, nprobe=8, itself=False))
    assert len(found & exact) >= 0.9 * len(exact)
    # what a few queries read: the files of their cells, against all
    few = asked.limit(2)
    probed = [r.cell for r in index.probes(few, 4).select("cell").distinct().collect()]
    plan = index.scan(probed)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scanned = {f for f in index.scan(probed).selectExpr("_metadata.file_path f", "_metadata.file_size s").distinct().collect()}
    whole = index.scan().selectExpr("_metadata.file_path f", "_metadata.file_size s").distinct().collect()
    assert 0 < sum(r.s for r in scanned) < 0.5 * sum(r.s for r in whole)
    assert pairs(index.search(few, 10, nprobe=32, itself=False)) == pairs(V.search(rows, few, 10))


def test_all_cells_give_the_exact_result_however_cells_and_queries_are_dealt(tables, index, monkeypatch):
    rows, asked = tables
    monkeypatch.setattr(cells, "SLICE", 50)
    monkeypatch.setattr(cells, "BLOCK", 30)
    one, two = (sorted((r.query_id, r.vec_id, round(r.score, 8), r["rank"]) for r in df.collect()) for df in (index.search(asked, 5, 32), V.nearest(rows, asked, 5)))
    assert one == two


def test_training_lowers_the_distance(tables):
    rows, _ = tables
    x = np.array([r.embedding for r in rows.collect()])
    far = lambda c: ((x - c[cells.nearest_cells(x, c)]) ** 2).sum()
    assert far(cells.train(rows, 32, 10**6, 8)) < 0.9 * far(cells.train(rows, 32, 10**6, 0))


def test_vectors_are_added_replaced_and_removed(spark, tmp_path):
    x = clustered(300, 5, 6)
    rows = lambda ids, sign=1: spark.createDataFrame([(i, (sign * x[i]).tolist()) for i in ids], ID)
    found = cells.CellIndex(spark, f"file://{tmp_path}/ix")
    assert found.search(rows([1]).withColumnRenamed("vec_id", "query_id"), 3).count() == 0
    odd = spark.createDataFrame([(None, [1.0] * 6), (999, None)], ID)
    found.build(rows(range(200)).unionByName(odd), nlist=8)
    found.add(rows(range(150, 300), -1))
    found.remove(spark.createDataFrame([(5,), (170,), (12345,)], "vec_id long"))
    left = rows([i for i in range(150) if i != 5]).unionByName(rows([i for i in range(150, 300) if i != 170], -1))
    asked = rows(range(0, 300, 7)).withColumnRenamed("vec_id", "query_id")
    assert pairs(found.search(asked, 4, 8)) == pairs(V.nearest(left, asked, 4))


def test_empty_table(spark, tmp_path):
    found = cells.CellIndex(spark, f"file://{tmp_path}/ix")
    found.build(spark.createDataFrame([], ID))
    assert found.search(spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<double>"), 3).count() == 0
