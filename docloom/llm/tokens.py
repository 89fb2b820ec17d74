"""Exact encoding with a file of the tokenizers library, made faster by remembering words.

A vocabulary that lower-cases, drops white space and cuts letters from marks before its merges gives a
text's ids as the ids of its words, one after the other. ``Encoder`` uses that for texts of plain Latin
characters and asks the library for each new word only; any other text, or any other kind of
vocabulary, goes through the library as a whole.
"""

from __future__ import annotations

import ctypes
import gc
import json
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pattern of vocabularies that the short way is right for (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that the library might compose, drop, or lower-case by context; and special tokens.
UNUSUAL = r"[^\t-\r\x20-\x7e\x{a1}-\x{12f}]|<\|"
#: A lone full stop or comma after a letter or digit: always a token of its own.
ENDED = r"([a-z0-9\x{df}-\x{f6}\x{f8}-\x{12f}])([.,])([\t-\r ])"
#: What pieces an ASCII word without an apostrophe has.
PIECES = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
#: Characters of text that one call takes well.
SLICE_CHARS = 4_000_000


class Encoder:
    WORDS = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        size = self.library.get_vocab_size()
        self.type = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.by_word = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"].get("Regex") == SPLIT
            and not cuts[1]["add_prefix_space"]
            and not cuts[1]["use_regex"]
            and spec.get("post_processor") is None
        )
        if self.by_word:
            self.letters = Tokenizer.from_file(path)  # for lower-case words of letters alone
            self.letters.normalizer = normalizers.Sequence([])
            self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            model = self.letters.model
            if hasattr(model, "_resize_cache"):  # every word is asked for once, so remembering it there costs time
                model._resize_cache(0)
                self.letters.model = model
        self._forget()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type)

    def _forget(self) -> None:
        #: Words by place; the ids of place i are ids[begin[i] : begin[i + 1]].
        self.known: dict[str, int] = {}
        self.begin = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, self.type)
        #: The last call that met the word of a place.
        self.used = np.zeros(1 << 12, np.int64)
        self.calls = 0

    def _shrink(self) -> None:
        """Keeps the half of the words that were met last."""
        n = len(self.known)
        keep = np.flatnonzero(self.used[:n] > np.median(self.used[:n]))
        words, lengths = list(self.known), np.diff(self.begin[: n + 1])[keep]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.begin[keep] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        calls = self.calls
        self._forget()
        self._add([words[i] for i in keep.tolist()], ids, lengths)
        self.calls = calls

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, at = len(self.known), int(self.begin[len(self.known)])
        if n + len(words) + 1 > len(self.begin):
            more = np.zeros(len(self.begin) + len(words), np.int64)
            self.begin, self.used = np.concatenate([self.begin, more]), np.concatenate([self.used, more])
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), self.type)])
        self.begin[n + 1 : n + 1 + len(words)] = at + np.cumsum(lengths)
        self.ids[at : at + len(ids)] = ids
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _letters(self, words: list[str]) -> None:
        got = self.letters.encode(words, is_pretokenized=True, add_special_tokens=False)
        self._add(words, np.array(got.ids, self.type), np.bincount(np.array(got.word_ids, np.int64), minlength=len(words)))

    def _whole(self, words: list[str]) -> None:
        if words:
            found = [got.ids for got in self.library.encode_batch_fast(words, add_special_tokens=False)]
            self._add(words, np.array([i for ids in found for i in ids], self.type), np.array([len(ids) for ids in found], np.int64))

    def _of(self, word: str) -> np.ndarray:
        at = self.known[word]
        return self.ids[self.begin[at] : self.begin[at + 1]]

    def _learn(self, plain: list[str], other: list[str]) -> None:
        if plain:
            self._letters(plain)
        whole, pieces = [], []
        for w in other:
            if w and w.isascii() and "'" not in w:
                pieces.append((w, PIECES.findall(w)))
            else:
                whole.append(w)
        parts = {p for _, found in pieces for p in found if p not in self.known}
        if letters := [p for p in parts if p.isalpha()]:
            self._letters(letters)
        self._whole(whole + [p for p in parts if not p.isalpha()])
        pieces = [(w, found) for w, found in pieces if w not in self.known]
        if pieces:
            joined = [np.concatenate([self._of(p) for p in found]) for _, found in pieces]
            self._add([w for w, _ in pieces], np.concatenate(joined), np.array([len(x) for x in joined], np.int64))

    def encode(self, texts: list) -> list[np.ndarray]:
        """The ids of each text; null is an empty text."""
        if not self.by_word:
            return [self.whole(t or "") for t in texts]
        array = pa.array([t or "" for t in texts], pa.large_string())
        odd = pc.match_substring_regex(array, UNUSUAL).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(array.filter(pa.array(~odd))), ENDED, r"\1 \2\3"))
        found = lists.flatten().dictionary_encode()
        at, words = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.WORDS:
            self._shrink()
        self.calls += 1
        places = list(map(self.known.get, words))
        if missing := [i for i, p in enumerate(places) if p is None]:
            plain = pc.utf8_is_alpha(found.dictionary).to_numpy(zero_copy_only=False)
            self._learn([words[i] for i in missing if plain[i]], [words[i] for i in missing if not plain[i]])
            known = self.known
            for i in missing:
                places[i] = known[words[i]]
        place = np.array(places, np.int64) if places else np.zeros(0, np.int64)
        self.used[place] = self.calls
        begins, lengths = self.begin[place], self.begin[place + 1] - self.begin[place]
        counts = lengths[at]
        ends = np.cumsum(counts)
        source = np.repeat(begins[at] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.ids[source]
        bounds = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out: list = [None] * len(texts)
        for i, a, b in zip(np.flatnonzero(~odd).tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file; workers keep it from task to task, until they take up other work (``release``)."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Lets the process's encoder go, with the words that it remembers, and returns the memory to the machine."""
    if not _ENCODERS:
        return
    _ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
