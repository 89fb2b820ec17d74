"""The class model: counts by brute force, probabilities that sum to 1, moves that are the best ones."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from words import prose

from docloom.llm import brown

SMALL = brown.Config(classes=6, unit_share=2**-5, groups=8, known_share=2**-5)


def languages(n, seed=1):
    """Texts that each stay within one of three vocabularies."""
    rng = random.Random(seed)
    return [(i, " ".join(f"{'xyz'[i % 3]}{min(rng.randrange(60), rng.randrange(60))}{'.' if rng.random() < 0.1 else ''}" for _ in range(rng.randrange(5, 60)))) for i in range(n)]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [" "]


def test_base_scores_and_counts_equal_brute_force(make, odd):
    docs = make([(i, t.upper() if i % 9 == 0 else t) for i, t in languages(120)] + [(901, "É É unseen"), (902, "STRASSE straße")]).unionByName(odd)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10((counts[w] + 1) / (total + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    for config in (SMALL, brown.Config(classes=6)):
        got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in brown.scores(docs, config).collect())
        assert got == want


def test_counts_sent_or_joined_give_one_score(make):
    """What share of the words is known to every task doesn't change a score."""
    docs = make(languages(90))
    one, two = ({r.doc_id: r.score for r in brown.scores(docs, c).collect()} for c in (SMALL, brown.Config(classes=6, unit_share=2**-5, groups=8)))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)


@pytest.fixture(scope="module")
def model(make):
    docs = make(languages(150))
    train = docs.select(brown.texts(docs, "text").alias("__text"))
    return brown.learn(train, brown.word_counts(train).cache(), brown.Config(classes=6, unit_share=2**-9, groups=8)), docs.collect()


def test_probabilities_sum_to_one(model):
    m, _ = model
    assert np.allclose((10**m.transitions).sum(axis=1), 1)
    words = Counter()
    for w, n in m.known.items():
        words[int(m.classes[m.units[w]])] += n - m.word_discount
    for c in range(1, 6):
        assert abs(words[c] / 10 ** m.sizes[c] + 10 ** (m.unknown[c] - m.sizes[c]) - 1) < 1e-9


def test_scores_follow_the_definition(model):
    m, rows = model
    scorer, where = brown.Scorer(m), lambda w: int(m.classes[m.units[w]])
    for r in rows[:20]:
        was, want = 0, 0.0
        for w in [*r.text.encode().split(), brown.END]:
            c = where(w)
            want += m.transitions[was, c] + (0 if w == brown.END else math.log10(m.known[w] - m.word_discount) - m.sizes[c])
            was = c
        n, known, _, score, rest = scorer.text(r.text.encode())
        assert (n, known, rest) == (len(r.text.split()) + 1, n, []) and abs(score - want) < 1e-9
    _, known, _, score, rest = scorer.text(b"never seen seen")
    assert known == 1 and [(x["word"], x["n"]) for x in rest] == [(b"never", 1), (b"seen", 2)]


def test_moves_are_the_best_ones():
    rng = np.random.default_rng(3)
    for trial in range(20):
        k, units = 4, 9
        pairs = rng.integers(0, 6, (units, units)) * (rng.random((units, units)) < 0.5)
        classes = np.r_[0, rng.integers(1, k, units - 1)]

        def table(c, pairs=pairs):
            out = np.zeros((4, 4))
            np.add.at(out, (c[:, None].repeat(9, 1), c[None].repeat(9, 0)), pairs)
            return out

        now, counts = classes.copy(), table(classes)
        near = [np.array([(v, pairs[u, v], pairs[v, u]) for v in range(units) if pairs[u, v] or pairs[v, u]] or np.empty((0, 3), int)).reshape(-1, 3) for u in range(units)]
        for u in range(1, units):
            before = now.copy()
            brown.exchange([u], [near[u]], now, counts)
            assert np.allclose(counts, table(now))
            each = [brown.likelihood(table(np.r_[before[:u], c, before[u + 1 :]])) for c in range(1, k)]
            assert abs(brown.likelihood(counts) - max(each)) < 1e-9


def test_likelihood_never_falls_and_classes_are_languages(model):
    m, _ = model
    assert all(a <= b for a, b in zip(m.likelihoods, m.likelihoods[1:], strict=False)) and m.likelihoods[-1] > m.likelihoods[0]
    by = Counter((w[:1], int(m.classes[m.units[w]])) for w, n in m.known.items() if w != brown.END and m.units[w] < m.units.first for _ in range(n))
    assert sum(max(n for (a, b), n in by.items() if b == c) for c in {b for _, b in by}) > 0.9 * sum(by.values())


def test_held_out_texts_score_above_smoothed_counts(make):
    docs = make(languages(400))
    found = [r for r in brown.scores(docs, brown.Config(classes=8)).collect() if r.held_out]
    assert len(found) > 30 and sum(r.score for r in found) > sum(r.base_score for r in found) * 0.9
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in found)


def test_without_training_rows(make):
    found = brown.scores(make([(i, prose(i, 5)) for i in range(200) if held(i)])).collect()
    assert found and all(r.train_tokens == r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in found)
