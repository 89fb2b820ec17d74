"""Word shingles of many texts at once, as 64-bit hashes.

Words are runs of characters other than ASCII white space, in lower case.
"""

from __future__ import annotations

import zlib

import numpy as np

WIDTH = 5
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat_words(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash a word, where each text begins and the last ends)."""
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    crc = zlib.crc32
    return np.fromiter((crc(w) for x in lists for w in x), np.uint64, int(bounds[-1])), bounds


def flat_shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, place of each in ``hashes``, where each text's shingles begin and the last end). Shorter texts have none."""
    counts = np.maximum(0, np.diff(bounds) - width + 1)
    starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    n = len(hashes)
    if n < width or not starts[-1]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), starts
    h = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        h = h * _P + hashes[j : n - width + 1 + j]
    places = np.arange(starts[-1]) + np.repeat(bounds[:-1] - starts[:-1], counts)
    return mixed(h[places]), places, starts
