"""Periodic runs: stretches of words that repeat with a period, found by comparing bit planes of word ids at a lag.

A text is its words (split at ASCII white space), each with an id. Bit i of plane b is bit b of word i's id, a plane
is one big integer. At lag q, plane XOR plane shifted by q, OR-ed over the planes, has a zero wherever words q apart
are identical; ANDs of the complement with itself, shifted by doubling amounts, leave the starts of zero stretches
that are long enough. A stretch whose words have a smaller period that divides q belongs to that period's run.

Which lags are worth it is found beforehand, for a slice of documents at once and without loss: within a run of
smallest period q <= s a window of s words occurs next exactly q later, and does so for more than q words on end, so
with s the next power of two lags are read off the gaps between equal windows. Windows double (pairs of ranks), and
those that occur once in their document are left. A scale s so yields at most min(s, 2 n / s) lags of a document
of n words: cost grows with n to the power 1.5 at worst, not with its square.

Defined cases: null and empty texts have no words and no run; repeated rows are searched each; very long texts are
searched whole; a null key stays null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: A run is of so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def least_length(period):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period)


def ranks(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the names, and each one's dense rank, in that order."""
    order = np.argsort(names, kind="stable")
    return order, np.cumsum(np.r_[False, names[order][1:] != names[order][:-1]])


def lags(ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """(document, lag) that may have runs, sorted; ``ids`` are the words of documents one after another, ``doc`` their documents."""
    n, found = len(ids), set()
    at, names, size = np.arange(n), doc * (int(ids.max(initial=0)) + 1) + ids, 1
    while len(at) > 1:
        order, rank = ranks(names)
        again = rank[1:] == rank[:-1]
        gap = np.zeros(len(at), np.int64)
        gap[order[:-1]] = np.where(again, at[order[1:]] - at[order[:-1]], 0)
        gap[(gap > size) | (2 * gap <= size)] = 0
        # stretches of positions on end whose windows recur at one and the same gap
        first = np.flatnonzero(np.r_[True, (gap[1:] != gap[:-1]) | (at[1:] != at[:-1] + 1)])
        q = gap[first]
        long = (q > 0) & (np.diff(np.r_[first, len(at)]) >= least_length(q) - q - size + 1)
        found.update(zip(doc[at[first[long]]].tolist(), q[long].tolist(), strict=True))
        # windows of twice the size, of those that recur
        keep = np.zeros(len(at), bool)
        keep[order[1:][again]] = keep[order[:-1][again]] = True
        of = np.full(n + size, -1, np.int64)
        dense = np.empty(len(at), np.int64)
        dense[order] = rank
        of[at[keep]] = dense[keep]
        at = at[keep]
        at = at[of[at + size] >= 0]
        at = at[doc[at] == doc[at + size]]
        names, size = of[at] * (int(rank[-1]) + 1) + of[at + size], 2 * size
    return sorted(found)


def planes(ids: np.ndarray) -> list[int]:
    """Bit planes of the ids: bit i of plane b is bit b of word i's id."""
    dense = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    bits = max(1, int(dense.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((dense >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def stretches(bit_planes: list[int], n: int, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``least`` words or more that equal the word ``lag`` later."""
    differ = 0
    for plane in bit_planes:
        differ |= plane ^ plane >> lag
    same, have = ~differ & (1 << n - lag) - 1, 1
    while same and have < least:
        step = min(have, least - have)
        same &= same >> step
        have += step
    bits = np.unpackbits(np.frombuffer(same.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little").astype(np.int8)
    edges = np.flatnonzero(np.diff(np.r_[np.int8(0), bits, np.int8(0)]))
    return edges[::2], edges[1::2] + least - 1


def runs_at(ids: np.ndarray, candidates: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run whose period is among the candidates, by start, then period."""
    n, found, known = len(ids), [], {}
    bit_planes = planes(ids)
    for q in sorted(candidates):
        start, end = stretches(bit_planes, n, q, int(least_length(q)) - q)
        end = end + q
        for d, (starts, ends) in known.items():
            if q % d == 0 and len(start):
                before = np.searchsorted(starts, start, "right") - 1
                inside = (before >= 0) & (ends[before] >= end)
                start, end = start[~inside], end[~inside]
        if len(start):
            known[q] = start, end
            found += zip(start.tolist(), (end - start).tolist(), [q] * len(start), strict=True)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def of_slice(texts: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each document of a slice, given as words."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in texts], np.int64)
    ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64, sizes.sum())
    ends = np.cumsum(sizes)
    by_doc: dict[int, list[int]] = {}
    for d, lag in lags(ids, np.repeat(np.arange(len(texts)), sizes)):
        by_doc.setdefault(d, []).append(lag)
    for d in range(len(texts)):
        yield runs_at(ids[ends[d] - sizes[d] : ends[d]], by_doc[d]) if d in by_doc else []


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its runs by start and period, and its text without their repeats.

    ``rewrite(key, words)`` gives the words to search in place of the text's own.
    """
    kind = docs.schema[key].dataType.simpleString()

    def step(keys, texts) -> Iterator[tuple]:
        split = [(t or b"").split() for t in texts]
        if rewrite:
            split = [rewrite(k, words) for k, words in zip(keys, split, strict=True)]
        for k, words, runs in zip(keys, split, of_slice(split), strict=True):
            yield k, len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs], collapsed(words, runs)

    rows = docs.select(F.col(key), F.col(text).cast("string").cast("binary").alias("__text"))
    out = map_rows(rows, [key, "__text"], f"`{key}` {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary", step)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each row's runs the number, the one of greatest length to period, and hashes of runs and collapsed text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs come by start and period: of ties the first stays
    top = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(key, F.size("runs").cast("long").alias("n_runs"), top.alias("__top"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        key, "n_runs", F.col("__top.start").alias("start"), F.col("__top.length").alias("length"), F.col("__top.period").alias("period"), F.expr("__top.length * 1000 div __top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
