import zlib

from words import prose

from docloom.llm import quality


def corpus(make, spark, n=120):
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = " ".join(w.upper() + "!!" for w in prose(i, 40).split()) if bad else prose(i, 60)
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(make, spark):
    docs, labels = corpus(make, spark)
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}
    from docloom.llm.common import label_bucket

    weights = quality.train(docs, labels.where(label_bucket("doc_id") != 0))
    out = {r.doc_id: r for r in quality.score(docs, weights).collect()}
    assert all(out[i].predicted == int(i % 3 != 0) for i in held)
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i in range(120) if i % 3}


def test_odd_rows_and_no_labels(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality.train(odd, none)
    assert not weights.any()
    rows = quality.score(odd, weights).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    assert quality.score(odd.limit(0), weights).count() == 0
    unknown = spark.createDataFrame([(99, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert not quality.train(odd, unknown).any()


def test_scores_are_sparse_dot_products():
    import numpy as np

    config = quality.Config(bits=10)
    weights = np.linspace(-1, 1, (1 << 10) + 1).astype(np.float32)
    text = "One two, two THREE 44 !!"
    at, x = quality.row(text, 10)
    z = float(weights[at].astype(float) @ x)
    assert abs(quality.score_texts([text], weights, config.bits)[0] - 1 / (1 + np.exp(-z))) < 1e-5
