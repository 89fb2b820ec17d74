import itertools

import numpy as np
from pyspark.sql import functions as F
from words import edited, prose

from docloom.llm import decontam, graph, probmin


def brute(rows, config=probmin.Config()):
    """Classes by comparing all pairs."""
    cells = [probmin.weighted([t or ""])[0] for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] or "") == (rows[j][1] or "") or probmin.similarity(cells[i], cells[j]) >= config.similarity:
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def test_classes_against_all_pairs(make):
    rows, n = [], 0
    for g in range(12):
        base = prose(g, 120)
        for k in range(g % 5 + 1):
            rows.append((n, base if k == 1 else edited(base, 2 * k, seed=g * 10 + k)))
            n += 1
    found = sorted(((r.doc_id, r.class_id) for r in probmin.classes(make(rows)).collect()), key=str)
    assert found == brute(rows)


def test_a_large_group_of_near_copies(make):
    base = prose(1, 150)
    rows = [(i, edited(base, i % 6, seed=i)) for i in range(150)] + [(1000 + i, prose(500 + i, 60)) for i in range(30)]
    found = sorted(((r.doc_id, r.class_id) for r in probmin.classes(make(rows)).collect()), key=str)
    assert found == brute(rows)


def test_a_group_whose_texts_are_mostly_too_far_apart_costs_no_square(make, monkeypatch):
    """Copies with up to 16 of 150 words changed each in its own way: most are near the original or nothing, and few pairs are worth comparing."""
    base, met = prose(1, 150), []
    rows = [(i, edited(base, i % 17, seed=i)) for i in range(300)]
    verify = probmin.verified

    def counted(pairs, *others):
        met.append(pairs.count())
        return verify(pairs, *others)

    monkeypatch.setattr(probmin, "verified", counted)
    found = sorted(((r.doc_id, r.class_id) for r in probmin.classes(make(rows)).collect()), key=str)
    assert found == brute(rows)
    assert sum(met) < 10 * len(rows), met  # of 44,850 pairs


def test_a_group_of_which_no_two_are_near_is_not_verified_pair_by_pair(make, monkeypatch):
    """Copies with 3 of 150 words changed each in its own way: each is near the original, which isn't there, and no two are near each other."""
    base, met = prose(1, 150), []
    rows = [(i, edited(base, 3, seed=i)) for i in range(200)]
    verify = probmin.verified

    def counted(pairs, *others):
        met.append(pairs.count())
        return verify(pairs, *others)

    monkeypatch.setattr(probmin, "verified", counted)
    found = sorted(((r.doc_id, r.class_id) for r in probmin.classes(make(rows)).collect()), key=str)
    assert found == brute(rows)
    assert sum(met) < 10 * len(rows), met  # of 19,900 pairs


def test_parities_differ_in_no_more_bits_than_texts_have_shingles_alone():
    texts = [t for g in range(30) for t in (prose(g, 40 + 30 * g), edited(prose(g, 40 + 30 * g), g, seed=g))]
    h, _, text = probmin.weighted(texts)
    x = probmin.parities(h, text, len(texts))
    cells = [h[text == i] for i in range(len(texts))]
    for i, j in itertools.combinations(range(len(texts)), 2):
        alone, bits = len(np.setxor1d(cells[i], cells[j])), int(np.bitwise_count(x[i] ^ x[j]).sum())
        assert bits <= alone and (alone - bits) % 2 == 0


def test_components_of_nodes_with_the_same_centres_and_of_chains(spark, monkeypatch):
    """Links that ten centres have with 400 nodes each are few after a round; a chain whose names are in no order is done in time."""
    import random

    stars = [(c, 1000 + n) for c in range(0, 100, 10) for n in range(400)]
    names = random.Random(5).sample(range(10_000, 20_000), 300)
    chain = list(zip(names, names[1:]))
    keep, sizes = graph.materialize, []

    def counted(df, label):
        out = keep(df, label)
        sizes.append(out.count() if label == "pairs" else 0)
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    labels = {r.node: r.label for r in graph.components(spark.createDataFrame([*stars, *chain, (7, 7)], "a int, b int")).collect()}
    assert labels == {n: 0 for link in stars for n in link} | {n: min(names) for n in names}
    assert sum(sizes) < 2 * len(stars + chain), sizes
    assert graph.components(spark.createDataFrame([(7, 7)], "a int, b int")).count() == 0


def test_bridged_clusters_and_drifting_chains(make):
    rows = []
    for g in range(8):
        # two clusters around texts that aren't near, joined by one pair only
        a = prose(g + 300, 200).split()
        b = a[:70] + prose(g + 600, 24).split() + a[94:]
        c = b[:172] + prose(g + 700, 12).split() + b[184:]
        rows += [(1000 * g + k, t) for k, t in enumerate([*(" ".join(x[:-1 - k]) for x in (a, b, c) for k in range(6))])]
        text = prose(g + 800, 150)
        for k in range(12):
            rows.append((1000 * g + 500 + k, text))
            text = edited(text, 2, seed=100 * g + k)
    found = sorted(((r.doc_id, r.class_id) for r in probmin.classes(make(rows)).collect()), key=str)
    # two texts that share no bucket stay apart: the model of all pairs that do
    assert found == brute(rows)


def test_star_links_connect_what_all_pairs_connect(spark):
    import random

    rng = random.Random(3)
    near = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)}
    members = [(b, n, rng.randrange(5), 0) for b in range(4) for n in range(60)]
    table = spark.createDataFrame([(a, b, True) for a, b in sorted(near)], "a int, b int, near boolean")
    verify = lambda pairs: pairs.join(table, ["a", "b"], "left").fillna(False)
    links = graph.star_links(spark.createDataFrame(members, "bucket int, node int, rank int, k int"), verify, lambda m, q: F.col(f"{m}k") == F.col(f"{q}k"))
    label = list(range(60))
    for a, b in near:
        label = [label[b] if x == label[a] else x for x in label]
    found = {r.node: r.label for r in graph.components(links).collect()}
    assert found == {n: label.index(label[n]) for n in range(60) if label.count(label[n]) > 1}


def test_rounds_keep_no_tables_and_done_buckets_meet_no_more(spark, monkeypatch):
    keep, drop, live, sizes = graph.materialize, graph.remove, {}, {}
    at = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]

    def counted(df, label):
        if label in ("met", "apart"):  # a round's own members, and nothing of the rounds before
            assert sorted(x for x in live.values() if x in ("met", "active")) == ["active"] * (label == "apart" or "met" in sizes)
        out = keep(df, label)
        live[at(out)], sizes[label] = label, sizes.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    monkeypatch.setattr(graph, "remove", lambda df: (live.pop(at(df), None), drop(df)))
    # bucket 0: a chain of near members that its pivot does not link whole; buckets 1 to 3: none are near one another
    members = spark.createDataFrame([(b, 100 * b + n, n) for b in range(4) for n in range(8)], "bucket int, node int, rank int")
    links = graph.star_links(members, lambda p: p.withColumn("near", F.expr("b < 8 and b = a + 1")), lambda m, q: F.lit(True), slots=1)
    assert {r.node for r in graph.components(links).collect()} == set(range(8))
    assert sizes["met"] > 8 and sizes["apart"] <= 8
    assert not set(live.values()) - {"links", "labels"}  # the result, and what components() returned to this test


def test_odd_rows(odd, make):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = sorted(((r.doc_id, r.class_id) for r in probmin.classes(odd).collect()), key=str)
    assert found == brute(rows)
    assert probmin.classes(odd.limit(0)).count() == 0
    kept = probmin.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t in rows})
    clash = make([(1, prose(1, 30)), (2, prose(1, 30))]).selectExpr("doc_id", "text", "1 as __id", "2 as first_id", "3 as first_node", "4 as tainted")
    assert [tuple(r)[2:] for r in probmin.keep_one(clash).collect()] == [(1, 2, 3, 4)]
    assert probmin.keep_one(make([(None, "a"), (None, "b"), (None, "a")])).count() == 2


def test_registers_agree_with_probability_jaccard():
    rng = np.random.default_rng(3)
    a = np.sort(rng.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    b = np.sort(np.concatenate([a[:220], rng.choice(1 << 40, 60, replace=False).astype(np.uint64) + np.uint64(1 << 41)]))
    wa, wb = rng.integers(1, 6, len(a)).astype(float), rng.integers(1, 6, len(b)).astype(float)
    k = 4000
    sig = [probmin.signatures(h, w, np.zeros(len(h), np.int64), 1, k)[0] for h, w in ((a, wa), (b, wb))]
    exact = probmin.probability_jaccard((a, wa), (b, wb))
    slow = sum(1 / sum(max(wa2 / x, wb2 / y) for wa2, wb2 in full) for x, y, full in _pairs(a, wa, b, wb))
    assert abs(exact - slow) < 1e-9
    assert abs(np.mean(sig[0] == sig[1]) - exact) < 4 * (exact * (1 - exact) / k) ** 0.5


def test_pairs_whose_repeat_counts_differ(make):
    """Phrases said a hundred times in one text and once in the other, in texts of a Jaccard similarity of 0.8 to 1: all but a few are caught."""
    rows = []
    for g in range(120):
        base = prose(5000 + g, 104)
        phrase = " ".join(base.split()[40:64])
        rows.append((2 * g, base))
        # the joints of the repeats make four shingles more, a new ending makes as many more as it has words
        rows.append((2 * g + 1, " ".join([base, *[phrase] * 99, *prose(9000 + g, g % 9).split()])))
    cells = [probmin.weighted([t]) for _, t in rows]
    weights = [(h, probmin.saturated(n)) for h, n, _ in cells]
    near = [g for g in range(120) if probmin.similarity(cells[2 * g][0], cells[2 * g + 1][0]) >= 0.8]
    assert len(near) == 120 and min(probmin.probability_jaccard(weights[2 * g], weights[2 * g + 1]) for g in near) > 0.7
    caught = {r.class_id // 2 for r in probmin.classes(make(rows)).collect() if r.doc_id % 2 and r.class_id % 2 == 0}
    assert len(caught & set(near)) >= 0.97 * len(near)


def _pairs(a, wa, b, wb):
    x, y = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    full = [(x.get(d, 0.0), y.get(d, 0.0)) for d in x.keys() | y.keys()]
    return [(x[d], y[d], full) for d in x.keys() & y.keys()]


# benchmark items -------------------------------------------------------------------------------


def contained(docs, items, share=0.8):
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())

    out = set()
    for d, text in docs:
        own = grams(text)
        words = " " + " ".join((text or "").lower().split()) + " "
        for i, item in items:
            g = grams(item)
            short = 0 < len((item or "").split()) < 5
            hit = g and (f" {next(iter(g))} " in words if short else len(g & own) >= share * len(g))
            if hit:
                out.add((d, i))
    return out


def test_containment_against_brute_force(make, spark):
    items = [(i, prose(900 + i, 6 + 9 * i)) for i in range(8)] + [(20, "just three words"), (21, ""), (22, None)]
    docs = []
    for i, (_, text) in enumerate(items[:8]):
        docs.append((i, prose(i, 3000) + " " + text + " " + prose(50 + i, 2000)))
        docs.append((100 + i, prose(i, 50) + " " + edited(text, 1 + i // 3, seed=i) + " " + prose(70 + i, 300)))
    docs += [(300, "x just Three words y"), (301, None), (302, ""), (303, prose(1, 2))]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.search(make(docs), table).collect()}
    assert found == contained(docs, items)
    left = {r.doc_id for r in decontam.clean(make(docs), table).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in found}
    small = decontam.Config(block_bytes=300)
    assert {(r.doc_id, r.item_id) for r in decontam.search(make(docs), table, small).collect()} == found
    assert {r.doc_id for r in decontam.clean(make(docs), table, small).collect()} == left and decontam.clean(make(docs), table, small).columns == make(docs).columns


def test_items_of_few_words_in_long_documents():
    items = [(i, prose(2000 + i, 5 + i % 8 if i < 200 else 5)) for i in range(900)]
    texts = [prose(i, 150 + i % 16) + " " + text + " " + prose(i + 400, 150) for i, (_, text) in enumerate(items)]
    # the two shingles of an item of six words, apart from each other
    words = [text.split() for _, text in items if len(text.split()) == 6]
    texts += [" ".join(w[:5]) + " " + prose(i + 800, 100) + " " + " ".join(w[1:]) for i, w in enumerate(words)]
    found = decontam.Index(items).search(texts)
    assert {(t, i) for t, of in enumerate(found) for i, _, _ in of} == contained(list(enumerate(texts)), items)


def test_no_items_and_no_documents(odd, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.search(odd, none).count() == 0 and decontam.clean(odd, none).count() == odd.count()
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.search(odd.limit(0), some).count() == 0
