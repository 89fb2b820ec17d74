import random
import zlib

import numpy as np
import pytest
from words import prose

from docloom.llm import castore, counts, tokens
from docloom.llm.common import map_rows
from docloom.llm.tokens import encoder, vocabulary

ODD = ["", "it's don't we'll 's", "a<|endoftext|>b", "É İ ß ΑΣ Σ", "x\x85y\xa0 a\x1cb", "ª, º. a.b, 3.14 $5!! .. x_. y", "Áb é", "wh!? ;: a; b: c! 'tis they're", "÷. ×, a÷. ", "\n\n a \t b\n", "WORLD. Hello, World.\nx."]


@pytest.fixture(scope="module")
def codes():
    return encoder(vocabulary())


def test_words_give_the_library_s_ids(codes):
    texts = ODD + [prose(i, 200) for i in range(20)] + [" ".join(w.upper() + random.Random(i).choice(["!!", ".", ",", "###", ""]) for w in prose(i, 50).split()) for i in range(20)]
    for text, ids in zip(texts, codes.encode(texts), strict=True):
        assert ids.tolist() == codes.library.encode(text, add_special_tokens=False).ids, text


def test_forgetting_words_changes_nothing(codes):
    few = type(codes)(vocabulary())
    few.WORDS = 10
    for i in range(5):
        assert few.encode([prose(i, 60)])[0].tolist() == codes.encode([prose(i, 60)])[0].tolist()


def test_other_vocabularies_go_through_the_library(codes):
    other = encoder(vocabulary("byte_bpe_50k.json"))
    assert not other.by_word and other.encode(["a b", None])[0].tolist() == other.library.encode("a b", add_special_tokens=False).ids


def test_workers_let_the_encoder_go_when_they_take_up_other_work(spark):
    rows = spark.range(0, 8, 1, 8).selectExpr("id", "'some words' text")
    used = map_rows(rows, ["id", "text"], "n long", lambda own, ids, texts: [(len(own.encode(texts)),)], lambda: encoder(vocabulary()), encodes=True)
    assert used.count() == 8
    # the same workers take these tasks up, and none of them holds an encoder
    held = map_rows(rows, ["id", "text"], "n long", lambda ids, texts: [(len(tokens._ENCODERS),)])
    assert [r.n for r in held.collect()] == [0] * 8


# counts ----------------------------------------------------------------------------------------


def test_counts_follow_random_edits(codes):
    rng = random.Random(2)
    for seed in range(12):
        text = prose(seed, rng.randrange(0, 400)).replace("0 ", "0\n")
        doc = counts.Document(text, codes, 64)
        for _ in range(25):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.randrange(60))
            new = rng.choice(["", " ", "\n", "mid", " new words here ", "x" * 200])
            text = text[:a] + new + text[b:]
            doc.edit(a, b, new)
            assert doc.text == text and doc.chars == len(text)
        assert doc.tokens == len(codes.encode([text])[0])


def test_only_touched_segments_are_encoded(codes):
    doc = counts.Document(prose(1, 20_000), codes)
    before = len(doc.segments)
    doc.edit(1000, 1003, "abc")
    assert doc.encoded < 2000 and len(doc.segments) == before


def test_the_tree_stays_balanced(codes):
    def held(t):
        if t and t[0]:
            assert abs(t[3][0] - t[4][0]) <= 1 and t[:3] == (max(t[3][0], t[4][0]) + 1, t[3][1] + t[4][1], t[3][2] + t[4][2])
            held(t[3])
            held(t[4])

    rng = random.Random(5)
    doc = counts.Document(prose(1, 3000), codes, 16)
    for _ in range(60):
        a = rng.randrange(doc.chars + 1)
        doc.edit(a, a + rng.choice([0, 30, 3000]), rng.choice(["", " ", prose(3, rng.randrange(400))]))
        held(doc.root)


def by_the_library(text, edits, codes):
    """(characters, tokens) of the text before and after the edits, encoded whole."""
    now = text
    for start, end, new in edits:
        start = max(0, min(start, len(now)))
        now = now[:start] + new + now[max(start, min(end, len(now))) :]
    return tuple(x for t in (text, now) for x in (len(t), len(codes.library.encode(t, add_special_tokens=False).ids)))


def test_count_edits_of_odd_rows(odd, make, codes):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(i, t) for i, t in enumerate([*ODD, " \n ", "\n", prose(9, 500).replace("1 ", "\n")], 100)]
    want = [(d, *by_the_library(t or "", counts.sample_edits(t or ""), codes)) for d, t in rows]
    found = [(r.doc_id, r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) for r in counts.count_edits(make(rows), counts.sample_edits).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    none = counts.count_edits(make(rows), lambda t: [])
    assert all((r.n_chars, r.n_tokens, r.encoded_chars) == (r.edited_chars, r.edited_tokens, 0) for r in none.collect())
    assert counts.count_edits(odd.limit(0), counts.sample_edits).count() == 0


# store -----------------------------------------------------------------------------------------


def test_joined_crc32():
    rng = random.Random(1)
    parts = [rng.randbytes(rng.randrange(0, 3000)) for _ in range(40)]
    starts = np.array([0, 3, 4, 20])
    got = castore.joined_crc32(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([len(p) for p in parts]), starts)
    assert got.tolist() == [zlib.crc32(b"".join(parts[a:b])) for a, b in zip(starts, [*starts[1:], 40], strict=True)]


def test_cuts_move_only_beside_an_edit():
    ids = np.random.default_rng(1).integers(0, 49_000, 20_000).astype(np.uint16)
    config = castore.Config()

    def chunks(x):
        ends = castore.cuts(x, config)
        assert ends[-1] == len(x) and all(0 < b - a <= config.most for a, b in zip([0, *ends], ends, strict=False))
        return [x[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    one, two = chunks(ids), chunks(np.insert(ids, 9000, 7))
    assert len(set(one) - set(two)) <= 3
    assert castore.cuts(ids[:1], config) == [1]


def test_store_round_trip(odd, spark, codes, tmp_path):
    path = f"file://{tmp_path}/store"
    castore.write(odd, path)
    rows = odd.collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    whole = [(r.doc_id, codes.library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in order]
    got = castore.read_digests(spark, path).orderBy("start").collect()
    start = 0
    for r in got:
        ids = next(i for d, i in whole if d == r.doc_id and len(i) == r.n_tokens)
        assert (r.start, r.ids_crc32) == (start, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += r.n_tokens
    assert len(got) == len(rows) and start == sum(len(i) for _, i in whole)
    assert [r.doc_id for r in got] == [d for d, _ in whole]
    back = castore.reconstruct(spark, path).orderBy("start").collect()
    assert sorted(map(len, (r.ids for r in back))) == sorted(len(i) for _, i in whole)
    assert all(r.good for r in castore.verify(spark, path).collect())
    copies = [r for r in rows if r.doc_id in (4, 5)]
    assert len(copies) == 3 and castore.chunks(spark, path).select("key").distinct().count() == castore.chunks(spark, path).count()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 6, 7, 8, 11, 64, 100])
def test_merkle_of_leaves_one_by_one(n):
    tree, leaves = castore.Merkle(), [bytes([i]) for i in range(n)]
    for one in leaves:
        tree.add(one)
    assert tree.root() == castore.merkle(leaves)


def test_damage_is_told(make, spark, tmp_path):
    import shutil

    def store(name):
        path = f"{tmp_path}/{name}"
        castore.write(make([(i, prose(i, 900)) for i in range(6)]), f"file://{path}", castore.Config(range=2))
        return path, f"file://{path}"

    path, url = store("recipes")
    castore.check(spark, url)
    rows = [tuple(r) for r in spark.read.parquet(f"{url}/recipes").collect()]
    assert len({r[0] for r in rows}) > 1
    schema = spark.read.parquet(f"{url}/recipes").schema
    shutil.rmtree(f"{path}/recipes")
    spark.createDataFrame([(*r[:4], r[4] + 1, r[5]) if r[2] == 3 else r for r in rows], schema).write.parquet(f"{url}/recipes")
    with pytest.raises(ValueError):
        castore.check(spark, url)

    path, url = store("chunks")
    held = [tuple(r) for r in castore.chunks(spark, url).collect()]
    schema = castore.chunks(spark, url).schema
    for bad in (held[1:], [(held[0][0], held[0][1], b"x" * len(held[0][2])), *held[1:]]):
        shutil.rmtree(f"{path}/objects/kind=chunk")
        spark.createDataFrame(bad, schema).write.parquet(f"{url}/objects/kind=chunk")
        for read in (castore.reconstruct, castore.read_digests):
            with pytest.raises(Exception, match="missing|damaged"):
                read(spark, url).collect()


def test_empty_store(odd, spark, tmp_path):
    castore.write(odd.limit(0), f"file://{tmp_path}/none")
    assert castore.read_digests(spark, f"file://{tmp_path}/none").count() == 0
