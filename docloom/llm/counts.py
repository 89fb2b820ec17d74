"""Token counts that follow edits.

A document is kept as segments that begin at a word and end with white space, each with its number of tokens, as the leaves of
a height-balanced tree whose nodes sum up characters and tokens. An edit replaces a range of characters: the segments that it touches, with
one on a side where a word might join, are cut out, cut anew and encoded; only the nodes on the paths to them are made anew, however
many segments come or go, and all other segments keep their counts. The k-th edits of all documents of a slice are encoded in one
call. Counts equal those of encoding the whole edited text, as tokens never span white space in the vocabularies this is for.

Defined cases: null counts as an empty text, which has no segments and no tokens; edits are clipped to the text; edits
of one document are applied in their order, each to the text as it is then; a document without edits keeps its counts;
repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .tokens import Encoder, encoder, vocabulary

#: ASCII white space, which ends a token in every case.
WORD_START = re.compile(r"(?<=[\t-\r ])(?=[^\t-\r ])")


@dataclass(frozen=True)
class Config:
    vocabulary: str | None = None
    #: Characters of a segment, about.
    segment: int = 256


def cut(text: str, size: int = Config.segment) -> list[str]:
    """Segments of at least ``size`` characters that begin at a word (the first one with the text)."""
    out, start = [], 0
    while start < len(text):
        found = WORD_START.search(text, start + size) if start + size < len(text) else None
        end = found.start() if found else len(text)
        out.append(text[start:end])
        start = end
    return out


# the tree: (height, characters, tokens, left, right); a leaf is (0, characters, tokens, segment, None) and no leaf is None


def node(a: tuple, b: tuple) -> tuple:
    return (a[0] + 1 if a[0] > b[0] else b[0] + 1, a[1] + b[1], a[2] + b[2], a, b)


def tree(leaves: list[tuple]) -> tuple | None:
    if len(leaves) < 2:
        return leaves[0] if leaves else None
    half = len(leaves) // 2
    return node(tree(leaves[:half]), tree(leaves[half:]))


def joined(a: tuple | None, b: tuple | None) -> tuple | None:
    """The leaves of a, then those of b. Heights of a node's two sides differ by one at most."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] > b[0] + 1:
        left, right = a[3], joined(a[4], b)
        if right[0] <= left[0] + 1:
            return node(left, right)
        near, far = right[3], right[4]
        return node(node(left, near), far) if near[0] <= far[0] else node(node(left, near[3]), node(near[4], far))
    if b[0] > a[0] + 1:
        left, right = joined(a, b[3]), b[4]
        if left[0] <= right[0] + 1:
            return node(left, right)
        far, near = left[3], left[4]
        return node(far, node(near, right)) if near[0] <= far[0] else node(node(far, near[3]), node(near[4], right))
    return node(a, b)


def parted(t: tuple | None, char: int) -> tuple[tuple | None, tuple | None]:
    """The leaves before the one that holds the character, and the others."""
    if t is None:
        return None, None
    if not t[0]:
        return (t, None) if char >= t[1] else (None, t)
    if char < t[3][1]:
        a, b = parted(t[3], char)
        return a, joined(b, t[4])
    a, b = parted(t[4], char - t[3][1])
    return joined(t[3], a), b


def leftmost(t: tuple) -> tuple[tuple, tuple | None]:
    """The first leaf, and the others."""
    if not t[0]:
        return t, None
    first, rest = leftmost(t[3])
    return first, joined(rest, t[4])


def segments_of(t: tuple | None) -> list[str]:
    out, stack = [], [t] if t else []
    while stack:
        t = stack.pop()
        if t[0]:
            stack += [t[4], t[3]]
        else:
            out.append(t[3])
    return out


def leaves(segments: list[str], counts: list[int]) -> list[tuple]:
    return [(0, len(s), c, s, None) for s, c in zip(segments, counts, strict=True)]


def counted(codes: Encoder, segments: list[str]) -> list[int]:
    return [len(x) for x in codes.encode(segments)] if segments else []


class Document:
    """A text's segments and their counts. ``counts``: of the segments, if already known."""

    def __init__(self, text: str, codes: Encoder, size: int = Config.segment, segments: list[str] | None = None, counts: list[int] | None = None):
        self.codes, self.size = codes, size
        segments = cut(text, size) if segments is None else segments
        self.root = tree(leaves(segments, counted(codes, segments) if counts is None else counts))
        self.encoded = 0

    @property
    def tokens(self) -> int:
        return self.root[2] if self.root else 0

    @property
    def chars(self) -> int:
        return self.root[1] if self.root else 0

    @property
    def segments(self) -> list[str]:
        return segments_of(self.root)

    @property
    def text(self) -> str:
        return "".join(self.segments)

    def open(self, start: int, end: int, new: str) -> list[str]:
        """Cuts out what replacing characters start..end-1 touches; returns the segments that take its place. ``close`` takes their counts."""
        chars = self.chars
        start = max(0, min(start, chars))
        end = max(start, min(end, chars))
        before, rest = parted(self.root, min(start, chars - 1))
        at = before[1] if before else 0
        touched, after = parted(rest, min(end, chars - 1) - at)
        if after:  # the segment that holds the end is touched too
            first, after = leftmost(after)
            touched = joined(touched, first)
        old = "".join(segments_of(touched))
        if before and start == at:  # what stands before ends with white space, unless it is the text's first segment
            before, last = parted(before, at - 1)
            at -= last[1]
            old = last[3] + old
        region = old[: start - at] + new + old[end - at :]
        while after and (not region or region[-1] not in "\t\n\v\f\r "):
            first, after = leftmost(after)  # the next word may join
            region += first[3]
        self.sides = before, after
        self.encoded += len(region)
        return cut(region, self.size)

    def close(self, fresh: list[str], counts: list[int]) -> None:
        before, after = self.sides
        self.root = joined(joined(before, tree(leaves(fresh, counts))), after)

    def edit(self, start: int, end: int, new: str) -> list[str]:
        """Replaces characters start..end-1; returns the segments that were encoded anew."""
        fresh = self.open(start, end, new)
        self.close(fresh, counted(self.codes, fresh))
        return fresh


def many_counted(codes: Encoder, lists: list[list[str]]) -> Iterator[list[int]]:
    """The counts of each list's segments; all are encoded in one call."""
    flat, at = counted(codes, [s for found in lists for s in found]), 0
    for found in lists:
        yield flat[at : at + len(found)]
        at += len(found)


def count_edits(docs: DataFrame, edits, config: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, n_tokens, edited_chars, edited_tokens, encoded_chars) of every row.

    ``edits``: a function of a text that gives its edits, (start, end, new) in order.
    """
    file, size = config.vocabulary or vocabulary(), config.segment

    def step(codes, keys, texts) -> Iterator[tuple]:
        texts = [t or "" for t in texts]
        segments = [cut(t, size) for t in texts]
        held = [Document(t, codes, size, s, c) for t, s, c in zip(texts, segments, many_counted(codes, segments), strict=True)]
        before = [doc.tokens for doc in held]
        waiting = [(doc, iter(edits(t))) for doc, t in zip(held, texts, strict=True)]
        while waiting:  # the next edit of every document that has one
            now = [(doc, more, edit) for doc, more in waiting if (edit := next(more, None)) is not None]
            fresh = [doc.open(*edit) for doc, _, edit in now]
            for (doc, _, _), own, counts in zip(now, fresh, many_counted(codes, fresh), strict=True):
                doc.close(own, counts)
            waiting = [(doc, more) for doc, more, _ in now]
        for k, t, n, doc in zip(keys, texts, before, held, strict=True):
            yield k, len(t), n, doc.chars, doc.tokens, doc.encoded

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return map_rows(rows, [key, "text"], f"`{key}` {kind}, n_chars long, n_tokens long, edited_chars long, edited_tokens long, encoded_chars long", step, lambda: encoder(file), encodes=True)


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """A rule for edits: join the first two lines, insert a clause in the middle, replace a range at three quarters, drop the end."""
    n = len(text)
    first = text.find("\n")
    out = [(first, first + 1, "")] if first >= 0 else []
    return [*out, (n // 2, n // 2, " (as amended) "), (3 * n // 4, 3 * n // 4 + 12, "REDACTED"), (max(0, n - 7), n + 14, "")]
