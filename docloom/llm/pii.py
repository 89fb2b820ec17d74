"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A value that passes its kind's validation (a card's Luhn sum, an IBAN's remainder, a calendar date, ...) is ranked
among all values of its format, its rank is permuted by a Feistel network over exactly that many ranks (cycle walking
where the network's square is larger), and the new rank is written in the same format, checksums included. The
permutation depends on the key, the kind and the format alone, so equal values stay equal in all documents,
different ones stay different, and the holder of the key can invert it.

Defined cases: a null text stays null with no values found; an empty text stays empty; values of overlapping kinds go to the
first kind in order; digits that fail validation stay as they are; repeated rows give repeated results. Extra
columns are ignored, or carried along by ``pseudonymised``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from math import isqrt, prod

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows

ROUNDS = 10
#: For tests and examples; give your own.
DEFAULT_KEY = b"docloom: replace this key"

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
DIGITS = "0123456789"
HEX = DIGITS + "abcdef"


# permutations ----------------------------------------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, value: int, size: int) -> int:
    n = (value.bit_length() + 7) // 8
    width = (size.bit_length() + 7) // 8 + 8
    out, block = b"", 0
    while len(out) < width:
        out += blake2b(bytes([i, block]) + value.to_bytes(n, "big"), key=key[:64], person=blake2b(tweak, digest_size=16).digest(), digest_size=min(64, width)).digest()
        block += 1
    return int.from_bytes(out[:width], "big") % size


def permute(rank: int, size: int, key: bytes, tweak: bytes, forward: bool = True) -> int:
    """A keyed bijection of range(size)."""
    if size < 2:
        return rank
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(rank, b)  # left < a, right < b
        for i in range(ROUNDS) if forward else reversed(range(ROUNDS)):
            if i % 2:
                shift = _round(key, tweak, i, left, b)
                right = (right + (shift if forward else -shift)) % b
            else:
                shift = _round(key, tweak, i, right, a)
                left = (left + (shift if forward else -shift)) % a
        rank = left * b + right
        if rank < size:
            return rank


def by_position(text: str, classes: tuple[str, ...]) -> tuple[int, int, list[tuple[int, str]]]:
    """(rank, size, places): a text as a mixed-radix number; each character varies within the first class that has it."""
    places = [(i, next(c for c in classes if ch in c)) for i, ch in enumerate(text) if any(ch in c for c in classes)]
    rank = 0
    for i, c in places:
        rank = rank * len(c) + c.index(text[i])
    return rank, prod(len(c) for _, c in places), places


def written(text: str, rank: int, places: list[tuple[int, str]]) -> str:
    out = list(text)
    for i, c in reversed(places):
        rank, at = divmod(rank, len(c))
        out[i] = c[at]
    return "".join(out)


class Cipher:
    def __init__(self, key: bytes = DEFAULT_KEY, forward: bool = True):
        self.key, self.forward = key, forward
        self.done = lru_cache(50_000)(self._of)

    def _number(self, rank: int, size: int, tweak: str) -> int:
        return permute(rank, size, self.key, tweak.encode(), self.forward)

    def _classes(self, kind: str, text: str, classes: tuple[str, ...], good: Callable[[str], bool] = lambda _: True) -> str:
        rank, size, places = by_position(text, classes)
        shape = list(text)
        for i, c in places:
            shape[i] = f"<{classes.index(c)}>"
        tweak = f"{kind}|{''.join(shape)}"
        while True:
            rank = self._number(rank, size, tweak)
            if good(out := written(text, rank, places)):
                return out

    def _of(self, kind: str, text: str) -> str:
        return getattr(self, kind)(text)

    # kinds

    def card(self, text: str) -> str:
        at = [i for i, c in enumerate(text) if c.isdigit()]
        body = "".join(text[i] for i in at[:-1])
        body = f"{self._number(int(body), 10 ** len(body), f'card|{len(body)}'):0{len(body)}d}"
        new = body + check_digit(body)
        out = list(text)
        for i, c in zip(at, new, strict=True):
            out[i] = c
        return "".join(out)

    def iban(self, text: str) -> str:
        flat = text.replace(" ", "")
        body = self._classes("iban" + flat[:2], flat[4:], (DIGITS, UPPER))
        new = iter(flat[:2] + f"{98 - int(_letters(body + flat[:2] + '00')) % 97:02d}" + body)
        return "".join(c if c == " " else next(new) for c in text)

    def phone(self, text: str) -> str:
        at = [i for i, c in enumerate(text) if c.isdigit()][-10:]
        # the ten digits alone, so that a number is linked however it is written
        new = self._classes("phone", "".join(text[i] for i in at), (DIGITS,), good_nanp)
        out = list(text)
        for i, c in zip(at, new, strict=True):
            out[i] = c
        return "".join(out)

    def ssn(self, text: str) -> str:
        return self._classes("ssn", text, (DIGITS,), good_ssn)

    def ip(self, text: str) -> str:
        rank = int.from_bytes(bytes(map(int, text.split("."))), "big")
        while True:
            rank = self._number(rank, 1 << 32, "ip")
            if good_ip(out := ".".join(map(str, rank.to_bytes(4, "big")))):
                return out

    def day(self, text: str) -> str:
        form = date_format(text)
        order, sep = _DAYS[form]
        rank = (read_date(text) - FIRST_DAY).days
        while True:
            rank = self._number(rank, N_DAYS, "date")
            new = FIRST_DAY + timedelta(days=rank)
            parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            if date_format(out := sep.join(parts[c] for c in order)) == form:
                return out

    def email(self, text: str) -> str:
        name, at, host = text.rpartition("@")
        site, dot, top = host.rpartition(".")
        return self._classes("email", name, (LOWER, UPPER, DIGITS)) + at + self._classes("host", site, (LOWER, UPPER, DIGITS)) + dot + top

    def secret(self, text: str) -> str:
        if re.fullmatch("[0-9a-f]+", text):
            return self._classes("secret", text, (HEX,))
        if text[:4] == "AKIA":
            return "AKIA" + self._classes("aws", text[4:], (UPPER + DIGITS,))
        return self._classes("secret", text, (LOWER, UPPER, DIGITS))


# validation ------------------------------------------------------------------------------------

FIRST_DAY = date(1900, 1, 1)
N_DAYS = (date(2100, 1, 1) - FIRST_DAY).days
_DAYS = {"iso": ("ymd", "-"), "slash": ("ymd", "/"), "dmy.": ("dmy", "."), "dmy/": ("dmy", "/"), "mdy/": ("mdy", "/"), "dmy-": ("dmy", "-")}


def check_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def good_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and check_digit(digits[:-1]) == digits[-1]


def _letters(text: str) -> str:
    return "".join(str(int(c, 36)) for c in text)


def good_iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int(_letters(flat[4:] + flat[:4])) % 97 == 1


def good_nanp(digits: str) -> bool:
    return len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789" and digits[1:3] != "11"


def good_phone(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return good_nanp(digits[-10:]) and digits[:-10] in ("", "1")


def good_ssn(text: str) -> bool:
    a, b, c = text.split("-")
    return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"


def good_ip(text: str) -> bool:
    parts = text.split(".")
    return all(p == str(int(p)) and int(p) < 256 for p in parts) and 0 < int(parts[0]) < 224


def date_format(text: str) -> str:
    if text[4] in "-/":
        return "iso" if text[4] == "-" else "slash"
    if text[2] == ".":
        return "dmy."
    if text[2] == "-":
        return "dmy-"
    # month first where that may be; the choice depends on the written form alone
    return "mdy/" if int(text[:2]) <= 12 else "dmy/"


def read_date(text: str) -> date | None:
    order, sep = _DAYS[date_format(text)]
    parts = dict(zip(order, map(int, text.split(sep)), strict=True))
    try:
        found = date(parts["y"], parts["m"], parts["d"])
    except ValueError:
        return None
    return found if 0 <= (found - FIRST_DAY).days < N_DAYS else None


#: kind, pattern (the value is its group 1, or all), validation; in order of precedence.
KINDS: list[tuple[str, re.Pattern, Callable[[str], bool]]] = [
    ("secret", re.compile(r"\b(AKIA[A-Z0-9]{16})\b"), lambda _: True),
    ("secret", re.compile(r"(?i:\b(?:token|secret|api[_-]?key|passw(?:or)?d|pwd)\b\s*[=:]\s*[\"']?)([A-Za-z0-9+/_-]{8,}={0,2})"), lambda t: any(c.isdigit() for c in t)),
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])"), lambda _: True),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), good_iban),
    ("card", re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"), good_card),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), good_ip),
    ("phone", re.compile(r"(?<![\w.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"), good_phone),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), good_ssn),
    ("day", re.compile(r"(?<![\w./-])(?:\d{4}([-/])\d{2}\1\d{2}|\d{2}([./-])\d{2}\2\d{4})(?![\w/-]|\.\d)"), lambda t: read_date(t) is not None),
]
#: No kind has a value without a digit or an at sign.
ANY = re.compile(r"[0-9@]")


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the valid values, apart and in order."""
    if not ANY.search(text):
        return []
    taken: list[tuple[int, int, str]] = []
    for kind, pattern, good in KINDS:
        group = 1 if kind == "secret" else 0
        for m in pattern.finditer(text):
            for a, b in parts(text, *m.span(group)) if kind == "card" else [m.span(group)]:
                if good(text[a:b]) and all(b <= s or a >= e for s, e, _ in taken):
                    taken.append((a, b, kind))
                    break
    return sorted(taken)


def parts(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A run of digit groups, and what is left of it without groups at its ends, the longest first: a number may stand beside a card's."""
    starts = [a] + [i + 1 for i in range(a, b) if not text[i].isdigit()]
    ends = [i for i in range(a, b) if not text[i].isdigit()] + [b]
    yield from sorted(((s, e) for s in starts for e in ends if e - s >= 13), key=lambda x: (x[0] - x[1], x))


def replace(text: str, cipher: Cipher) -> tuple[str, list[tuple[int, int, str]]]:
    spans = find(text)
    if not spans:
        return text, spans
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], cipher.done(kind, text[a:b])]
        at = b
    return "".join(out) + text[at:], spans


# columns ---------------------------------------------------------------------------------------


def session_key(spark: SparkSession) -> bytes:
    """The key in the session's setting ``spark.docloom.pii.key``; without one, ``DEFAULT_KEY``, which anyone can invert."""
    return spark.conf.get("spark.docloom.pii.key", DEFAULT_KEY.decode()).encode()


def pseudonymise(docs: DataFrame, secret: bytes | None = None, key: str = "doc_id", text: str = "text", forward: bool = True) -> DataFrame:
    """(key, text, n_values, kinds) of every row: the text with pseudonyms, and the kinds of the values in order.

    ``secret``: the key; that of the session if none is given.
    """
    secret = session_key(docs.sparkSession) if secret is None else secret

    def step(cipher, keys, texts) -> Iterator[tuple]:
        for k, t in zip(keys, texts, strict=True):
            if t is None:
                yield k, None, 0, []
            else:
                new, spans = replace(t, cipher)
                yield k, new, len(spans), [kind for _, _, kind in spans]

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(F.col(key), F.col(text).cast("string").alias("text")), [key, "text"], f"`{key}` {kind}, text string, n_values int, kinds array<string>", step, lambda: Cipher(secret, forward))


def pseudonymised(secret: bytes = DEFAULT_KEY) -> Callable[[Column], Column]:
    """A column function that gives texts with pseudonyms."""
    @F.pandas_udf("string")
    def changed(texts: pd.Series) -> pd.Series:
        cipher = Cipher(secret)
        return texts.map(lambda t: None if t is None else replace(t, cipher)[0])

    return changed
