"""Periodic runs against all stretches at all lags, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from words import prose

from docloom.llm import periods, queries


def slow(words):
    """Every run by its definition: maximal stretches at every lag, but those whose smallest period is smaller."""
    found, ids = [], np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else np.empty(0)
    for q in range(1, len(words) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.r_[0, ids[q:] == ids[:-q], 0]))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = j + q - i
            if length >= max(6, 4 * q) and next(p for p in range(1, q + 1) if (ids[i + p : j + q] == ids[i : j + q - p]).all()) == q:
                found.append((i, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def shapes(seed):
    """Texts of few words, nested and touching repeats, long periods."""
    rng = random.Random(seed)
    out = [str(rng.randrange(3)) for _ in range(rng.randrange(30))]
    for _ in range(rng.randrange(5)):
        unit = [str(rng.randrange(rng.choice([2, 3, 50]))) for _ in range(rng.randrange(1, 12))]
        out += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))] + [str(rng.randrange(4)) for _ in range(rng.randrange(9))]
        if rng.random() < 0.3 and len(out) < 200:
            out = out * rng.randrange(1, 6)
    return out


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=6))
@settings(max_examples=200, deadline=None)
def test_runs_of_two_words(texts):
    split = [[w.encode() for w in t] for t in texts]
    assert list(periods.of_slice(split)) == [slow(t) for t in split]


def test_runs_of_nested_repeats():
    texts = [[w.encode() for w in shapes(seed)] for seed in range(400)]
    got = list(periods.of_slice(texts))
    assert got == [slow(t) for t in texts] and sum(map(len, got)) > 500
    # a document's runs don't depend on the slice that it is in
    assert got == [next(periods.of_slice([t])) for t in texts]


def test_long_texts_cost_in_proportion():
    """A run of a long period in 200,000 words, and 200,000 words of one pair, are found whole."""
    words = prose(3, 30_000).encode().split()
    text = prose(4, 50_000).encode().split() + words * 5
    got = next(periods.of_slice([text]))
    assert [r for r in got if r[2] == 30_000] == [(50_000, 150_000, 30_000)] and len(got) == 1
    assert next(periods.of_slice([[b"a", b"b"] * 100_000])) == [(0, 200_000, 2)]


def test_query_equals_brute_force(spark, make, odd, tmp_path):
    rng = random.Random(1)
    docs = make([(i, " \n".join(shapes(i))) for i in range(150)] + [(200 + i, prose(i, rng.randrange(90))) for i in range(60)]).unionByName(odd)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in queries.op11_periods(spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    planted = 0
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(words), zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = slow(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want = (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
        assert want in found[r.doc_id]
    assert planted > 10


def test_collapsed_text(make):
    got = periods.periodic_runs(make([(1, "x a b a b a b a b\ty"), (2, None), (None, "q q q q q q")])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in got] == [(None, 6, "q", [(0, 6, 1)]), (1, 10, "x a b y", [(1, 8, 2)]), (2, 0, "", [])]


def test_planes_hold_the_ids():
    ids = np.array([5, 9, 5, 7, 1])
    bits = [[p >> i & 1 for i in range(5)] for p in periods.planes(ids)]
    assert len({tuple(x) for x in zip(*bits, strict=True)}) == 4
