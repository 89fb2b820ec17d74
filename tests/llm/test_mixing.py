import random
import re

from words import prose

from docloom.llm import mixing


def filled(sizes, weights, goal, cap=2):
    """Targets by sharing the excess anew until none is above its cap."""
    target, open_ = {}, dict(weights)
    while open_:
        level = (goal - sum(target.values())) / sum(open_.values())
        full = [s for s in open_ if open_[s] * level > cap * sizes[s]]
        if not full:
            return target | {s: w * level for s, w in open_.items()}
        for s in full:
            target[s] = cap * sizes[s]
            del open_[s]
    return target


def test_targets_and_taken_words(make):
    rows = [(i, prose(i, 5 + i * 7 % 200), f"src{i % 7}") for i in range(700)]
    out = mixing.mix(make(rows)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = {s: sum(n for i, n in size.items() if source[i] == s) for s in set(source.values())}
    goal = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * goal[s] + 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 0.02 * goal[s]
    assert sorted(map(tuple, mixing.mix(make(rows)).collect())) == sorted(map(tuple, out))


def test_a_small_source_beside_a_large_one(make):
    rows = [(i, prose(i, 5 + i * 7 % 200), "small" if i < 24 else "large") for i in range(700)]
    out = mixing.mix(make(rows), mixing.Config(weights=(60.0, 1.0), share=1.2, group=16)).collect()
    small = [r for r in out if r.doc_id < 24]
    assert abs(sum(r.taken for r in small) - small[0].target) <= 0.02 * small[0].target


def test_hundreds_of_small_sources(make):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(5, 300), f"s{i % 300:03}") for i in range(300 * 40)]
    out = mixing.mix(make(rows), mixing.Config(share=0.9)).collect()
    by = {}
    for r in out:
        by.setdefault(int(r.doc_id) % 300, []).append(r)
    for found in by.values():
        assert abs(sum(r.taken for r in found) - found[0].target) <= 0.01 * found[0].target
    misses = [abs(sum(r.taken for r in found) / found[0].target - 1) for found in by.values()]
    assert sum(misses) / len(misses) < 0.001


def test_several_groups_a_source(make):
    rows = [(i, "w " * (1 + i * 7919 % 400), "ab"[i % 3 > 0]) for i in range(9000)]
    out = mixing.mix(make(rows), mixing.Config(group=64)).collect()
    for source in (0, 1):
        found = [r for r in out if (r.doc_id % 3 > 0) == source]
        assert abs(sum(r.taken for r in found) - found[0].target) <= 0.01 * found[0].target


def test_rates_solve_the_dual(make):
    """Against bisection of each source's own equation, written without Spark."""
    import math

    rows = [(i, "w " * (1 + i * 7919 % 400), f"s{i % 5}") for i in range(1500)]
    config = mixing.Config()
    found = mixing.mix(make(rows), config).collect()
    for s in range(5):
        own = [r for r in found if r.doc_id % 5 == s]
        sizes, target = [r.size for r in own], own[0].target
        scale = sum(sizes) / len(sizes)
        if target >= config.cap * sum(sizes) * (1 - 1e-12):
            assert all(r.rate == config.cap for r in own)
            continue
        low, high = -1e3, 1e3
        for _ in range(200):
            mid = (low + high) / 2
            got = sum(n * min(config.cap, math.exp(min(700, mid * n / scale))) for n in sizes)
            low, high = (mid, high) if got < target else (low, mid)
        for r in own:
            assert abs(r.rate - min(config.cap, math.exp(min(700, low * r.size / scale)))) < 1e-4


def test_a_target_just_below_the_cap(make):
    """Nearly all rates are the cap: the tilt is steep, and its exp of a long document is no long."""
    rows = [(i, "w " * (20_000 if i == 0 else 2 + i % 300), "ab"[i % 2]) for i in range(600)]
    size = [sum(len(t.split()) for _, t, s in rows if s == own) for own in "ab"]
    # a's target is 1.98 times its size, b's the rest of the same total
    share = 1.5
    of_a = 1.98 * size[0]
    found = mixing.mix(make(rows), mixing.Config(weights=(of_a, share * sum(size) - of_a), share=share)).collect()
    own = [r for r in found if r.doc_id % 2 == 0]
    assert abs(own[0].target - of_a) <= 1e-6 * of_a and all(0 <= r.taken <= 2 * r.size for r in found)
    for odd in (0, 1):
        own = [r for r in found if r.doc_id % 2 == odd]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target


def test_the_mix_repeats_rows(make):
    docs = make([(i, prose(i, 30), "a" if i % 4 else None) for i in range(60)])
    rates = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {d: n for d, n in rates.items() if n}


def test_odd_rows(odd, make):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and all(r.taken <= 2 * r.size for r in out) and {r.size for r in out if r.doc_id in (1, 2)} == {0}
    assert mixing.mix(odd.limit(0)).count() == 0
    blank = mixing.mix(make([(1, "", "a"), (2, None, None)])).collect()
    assert [(r.size, r.taken, r.target) for r in blank] == [(0, 0, 0.0)] * 2
