"""The file source, the log sink and latency sketches."""

import random

import pytest

from docloom.operators import evaluation as E
from docloom.sources import document_files as D
from docloom.streaming.log_sink import LogSink


READER = """
def read(data):
    if data == b"%PDF bad":
        raise RuntimeError("damaged")
    return ["page one", "", "page three"]
"""


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "kb"
    (root / "cardio" / "deeper").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "a.txt").write_text("plain é")
    (root / "cardio" / "b.MD").write_text("# H\n![i](x.png)\n```\ncode\n```")
    (root / "cardio" / "d.pdf").write_bytes(b"%PDF")
    (root / "cardio" / "e.pdf").write_bytes(b"%PDF bad")
    (root / "bad.txt").write_bytes(b"\xff\xfe")
    (root / "noend").write_text("x")
    (root / "c.docx").write_text("no")
    (root / "empty.txt").write_text("")
    for hidden in (root / ".hidden.txt", root / ".git" / "x.txt", root / "cardio" / "deeper" / "z.txt"):
        hidden.write_text("no")
    return root


def test_every_file_has_a_row(spark, folder, tmp_path):
    (tmp_path / "made_up_pdf_reader.py").write_text(READER)
    spark.sparkContext.addPyFile(str(tmp_path / "made_up_pdf_reader.py"))
    rows = {r.filename: r for r in D.load(spark, str(folder), pdfReader="made_up_pdf_reader:read", groupBytes="10").collect()}
    assert set(rows) == {"a.txt", "b.MD", "d.pdf", "e.pdf", "bad.txt", "noend", "c.docx", "empty.txt"}
    assert (rows["a.txt"].full_text, rows["a.txt"].domain, rows["b.MD"].domain, rows["b.MD"].full_text) == ("plain é", "general", "cardio", "# H\n\ncode")
    assert [p.page for p in rows["d.pdf"].pages] == [1, 3] and rows["d.pdf"].total_pages == 2 and rows["empty.txt"].full_text == ""
    assert {n: r.error.split(":")[0] for n, r in rows.items() if r.error} == {"e.pdf": "RuntimeError", "bad.txt": "UnicodeDecodeError", "noend": "ValueError", "c.docx": "ValueError"}
    assert {r.filename for r in D.load(spark, f"file://{folder}", unknown="skip").collect()} == {"a.txt", "b.MD", "d.pdf", "e.pdf", "bad.txt", "empty.txt"}
    assert D.load(spark, str(folder), groupBytes="10").rdd.getNumPartitions() > 1


def test_one_document(spark, folder):
    assert D.load_document(spark, str(folder / "a.txt")).first().full_text == "plain é"
    with pytest.raises(ValueError):
        D.load_document(spark, str(folder / "c.docx"))
    with pytest.raises(FileNotFoundError):
        D.load_document(spark, str(folder / "none.txt"))
    with pytest.raises(Exception, match="FileNotFoundError"):
        D.load(spark, str(folder / "nowhere")).collect()


def test_a_stream_takes_a_file_up_once(spark, folder, tmp_path):
    def run():
        D.stream(spark, str(folder), unknown="skip").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.filename for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = run()
    assert len(first) == 6 and run() == first
    (folder / "later.txt").write_text("new")
    assert run() == sorted([*first, "later.txt"])


LOG = "id long, ts timestamp, event_type string, seconds double, text string"


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    sink = LogSink(spark, f"file://{tmp_path}/log")
    batch = lambda lo, hi: spark.createDataFrame([(i, None, "error" if i % 3 == 0 else "view", float(i), "x" * 300) for i in range(lo, hi)], LOG)
    assert sink.entries().count() == 0 and sink.stats().count() == 0
    sink.put("s", batch(0, 10), 0)
    sink.put("s", batch(10, 25), 1)
    # the log of batch 2 was written, its statistics weren't: the batch comes again
    sink._once(sink.log, "s", 2, lambda segment, was: sink.log.put(segment, "entries", batch(25, 30)), False)
    for number, (lo, hi) in enumerate([(0, 10), (10, 25), (25, 30)]):
        sink.put("s", batch(lo, hi), number)
    assert sorted(r.id for r in sink.entries().collect()) == list(range(30))
    assert all(len(r.text) == 200 for r in sink.entries().where("id < 25").collect())
    stats = {r.event_type: r for r in sink.stats().collect()}
    assert (stats["error"].total, stats["error"].errors, stats["view"].total, stats["view"].errors, stats["view"].longest) == (10, 10, 20, 0, 29.0)
    assert sum(r.seconds for r in stats.values()) == sum(range(30))
    sink.put("other", batch(100, 101), 0)  # another stream counts its own batches
    assert sink.entries().count() == 31


def test_sketches_of_days_keep_their_rank_error(spark):
    rng = random.Random(2)
    rows = [("a", d, rng.lognormvariate(0, 2)) for d in range(10) for _ in range(3_000)] + [("b", 1, 5.0)] * 50 + [("b", 2, None)]
    log = spark.createDataFrame(rows, "kind string, day int, seconds double").repartition(7)
    days = E.latency_sketches(log, "kind", "day")
    found = {r.kind: r for r in E.merged_latency(days, "kind").collect()}
    values = sorted(s for k, _, s in rows if k == "a")
    rank = sum(v <= found["a"].quantile for v in values) / len(values)
    assert abs(rank - 0.95) <= E.RANK_ERROR and found["a"].n == 30_000 and found["a"].max == values[-1] and abs(found["a"].avg - sum(values) / len(values)) < 1e-9
    assert (found["b"].n, found["b"].quantile) == (50, 5.0)
    assert max(len(r.sketch) for r in days.collect()) < 20_000


def test_a_watched_folder_is_listed_by_few_tasks(spark, tmp_path):
    """Not a task a file; the session's settings are as before."""
    from docloom.streaming import watcher

    (tmp_path / "in").mkdir()
    for i in range(300):
        (tmp_path / "in" / f"d{i}.txt").write_text(f"text {i}")
    keys = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")
    was, known = [spark.conf.get(k) for k in keys], spark.sparkContext.statusTracker()
    seen = {i for i in range(20_000) if known.getStageInfo(i)}
    watcher.ingest(watcher.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    tasks = [x.numTasks for i in range(20_000) if i not in seen and (x := known.getStageInfo(i))]
    assert tasks and max(tasks) < 100
    assert [spark.conf.get(k) for k in keys] == was
    assert spark.read.parquet(str(tmp_path / "out")).select("text").distinct().count() == 300


def test_a_watched_folder_gives_empty_files_and_odd_ids_a_row(spark, tmp_path, monkeypatch):
    """Over several folders, each file once: empty texts and negative ids too."""
    from docloom.plans import catalog
    from docloom.streaming import watcher

    rows = [(i, "" if i % 3 == 0 else f"text {i}" if i % 7 else None) for i in range(-15, 25)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    wanted = sorted((f"d{i}.txt", len(t)) for i, t in rows if t is not None)
    for most in (100, 15):
        monkeypatch.setattr(watcher, "FOLDER", most, raising=False)
        assert sorted(map(tuple, catalog.queries()["w1_directory_watcher"](spark, str(tmp_path)).collect())) == wanted
