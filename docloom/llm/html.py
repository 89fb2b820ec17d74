"""Main text of HTML pages by tag-path ratios.

A tolerant scanner turns a page into blocks of text, each with its root-to-leaf path of block elements (with their
ids and classes) and its length, punctuation and linked length. Elements that say what they are (menus, footers, forms,
adverts, comments, scripts) are left out first. The blocks' figures are summed up by tag path: text length a block, punctuation
a block, share of linked text. The fused ratio of its path gives a block its weight, which is smoothed over neighbouring blocks
in page order; sums by container path that reach a share of the best one's pass the threshold, and every block of such a
container is content, short ones included.

Defined cases: a null or empty page gives an empty text; unclosed and misplaced tags are tolerated as browsers do; a page of
plain text is one block; repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

OPEN = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE = re.compile(r"""\s*+/?\s*+([^\s=>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "head", "body", "article", "section", "main", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "nav", "header", "footer",
    "aside", "form", "fieldset", "details", "summary", "dialog", "menu", "hgroup", "center", "search", "legend",
}
BOILERPLATE = {"head", "nav", "footer", "aside", "form", "menu", "button", "select", "option", "dialog", "datalist", "label", "fieldset", "search", "object", "audio", "video", "canvas"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
WORDS = {
    "nav", "navbar", "navigation", "menu", "footer", "sidebar", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "newsletter", "subscribe", "popup", "modal", "overlay", "comment", "comments", "disqus", "reply", "replies", "share",
    "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "login", "signup", "widget", "masthead", "toolbar", "skip",
}
SPLIT_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: An opening one of these ends an open paragraph.
ENDS_P = BLOCK - {"html", "head", "body"}
PUNCTUATION = re.compile(r"[.,;:!?。！？，；：、…]")


@dataclass(frozen=True)
class Config:
    #: A container is content if its sum is at least this share of the best one's.
    threshold: float = 0.2
    #: Weights of a block itself and of the next ones on both sides.
    smoothing: tuple[float, ...] = (0.5, 0.2, 0.05)
    #: Linked share of a block's path beyond which it weighs nothing.
    most_linked: float = 0.6


@dataclass
class Block:
    path: str
    container: str
    text: str
    linked: int
    #: How many articles and mains it is in; the choice of content doesn't ask.
    home: int


def unwanted(name: str, attributes: dict[str, str], inside: bool) -> bool:
    if name in BOILERPLATE or name == "header" and not inside:
        return True
    if attributes:
        if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
            return True
        if name in ("html", "body", "main") or name == "article" and not inside:
            return False
        for key in ("class", "id"):
            if key in attributes and not WORDS.isdisjoint(SPLIT_WORDS.split(attributes[key].lower())):
                return True
            if key in attributes and not WORDS.isdisjoint(w.lower() for w in SPLIT_WORDS.split(attributes[key])):
                return True
    return False


def blocks(html: str) -> list[Block]:
    """The blocks of a page that no element marks as something else than content, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, path step, unwanted, article or main
    skip = inside = links = 0
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                steps = [s for name, s, _, _ in stack if name in BLOCK]
                leaf = steps[:-1] if steps and stack_leaf() not in ("body", "html") else steps
                out.append(Block("/".join(steps), "/".join(leaf), text, linked, inside))
            held = []
        linked = 0

    def stack_leaf() -> str:
        return next((name for name, _, _, _ in reversed(stack) if name in BLOCK), "")

    def drop(i: int) -> None:
        nonlocal skip, inside, links
        name, _, bad, home = stack.pop(i)
        skip -= bad
        inside -= home
        links -= name == "a"

    def close(name: str, stop: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                if name in BLOCK or any(x[0] in BLOCK for x in stack[i:]):
                    flush()
                if name not in BLOCK and any(x[0] in BLOCK for x in stack[i + 1 :]):
                    drop(i)
                    return
                while len(stack) > i:
                    drop(len(stack) - 1)
                return
            if stack[i][0] in stop:
                return

    def words(start: int, stop: int) -> None:
        nonlocal linked
        if not skip and start < stop:
            text = html[start:stop]
            held.append(text)
            if links:
                linked += len(text.strip())

    at, n = 0, len(html)
    while at < n:
        found = OPEN.search(html, at)
        if not found:
            words(at, n)
            break
        words(at, found.start())
        token, start = found[0], found.start()
        if token == "<!--":
            end = html.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if token[1] in "!?":
            end = html.find(">", start)
            at = n if end < 0 else end + 1
            continue
        closing = token[1] == "/"
        named = NAME.match(html, start + 1 + closing)
        name, at, attributes = named[0].lower(), named.end(), {}
        while at < n and html[at] != ">":
            more = ATTRIBUTE.match(html, at)
            if not more or more.end() == at:
                at += 1
                continue
            if not closing:
                attributes.setdefault(more[1].lower(), unescape(more[2] or more[3] or more[4] or ""))
            at = more.end()
        selfclosed = html[at - 1 : at] == "/"
        at = min(n, at + 1)
        if closing:
            if name == "p" and not any(x[0] == "p" for x in stack):
                flush()
            elif name == "br":
                held.append(" ")
            else:
                close(name, frozenset() if name in ("html", "body") else frozenset({"table"}) if name in ("li", "p") else frozenset())
            continue
        if name in RAW:
            if not selfclosed or name not in ("svg", "math"):
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                if end:
                    stop = html.find(">", end.end())
                    at = n if stop < 0 else stop + 1
                elif name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"):
                    at = n
            continue
        if name in VOID:
            if not skip:
                held.append(" ")
                if name == "hr":
                    flush()
            continue
        if name in BLOCK:
            flush()
            if name in ENDS_P:
                close("p", frozenset({"table", "div", "section", "article", "td", "th", "body", "button"}) - {name})
            if name == "li":
                close("li", frozenset({"ul", "ol", "menu"}))
            elif name in ("dt", "dd"):
                close("dt", frozenset({"dl"}))
                close("dd", frozenset({"dl"}))
            elif name in ("td", "th"):
                close("td", frozenset({"tr", "table"}))
                close("th", frozenset({"tr", "table"}))
            elif name == "tr":
                close("tr", frozenset({"table"}))
            elif name == "body":
                close("head")
        elif name == "option":
            close("option", frozenset({"select"}))
        home = name in ("article", "main")
        bad = unwanted(name, attributes, bool(inside))
        step = name + "".join(sign + "_".join(attributes[k].split()) for sign, k in (("#", "id"), (".", "class")) if attributes.get(k))
        if selfclosed and name not in BLOCK:
            continue
        stack.append((name, step, bad, home))
        skip += bad
        inside += home
        links += name == "a"
    flush()
    return out


def ratios(found: list[Block], config: Config = Config()) -> dict[str, float]:
    """The fused ratio of every tag path: text length a block times punctuation a block, without mostly linked paths."""
    sums: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for b in found:
        s = sums[b.path]
        s[0] += len(b.text)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
        s[3] += b.linked
    return {path: 0.0 if linked > config.most_linked * length else (length / n) * (0.5 + punctuation / n) * (1 - linked / length) for path, (length, punctuation, n, linked) in sums.items()}


def content(found: list[Block], config: Config = Config()) -> list[Block]:
    fused = ratios(found, config)
    raw = [fused[b.path] for b in found]
    smooth = []
    for i in range(len(raw)):
        total = raw[i] * config.smoothing[0]
        for d, w in enumerate(config.smoothing[1:], 1):
            total += w * ((raw[i - d] if i >= d else 0.0) + (raw[i + d] if i + d < len(raw) else 0.0))
        smooth.append(total)
    sums: dict[str, float] = defaultdict(float)
    for b, w in zip(found, smooth, strict=True):
        sums[b.container] += w * len(b.text)
    best = max(sums.values(), default=0.0)
    if not best:
        return found
    good = {c for c, v in sums.items() if v >= config.threshold * best}
    inside_good = tuple(c + "/" for c in good)
    return [b for b in found if b.container in good or b.container.startswith(inside_good) and fused[b.path] > 0]


def main_text(html: str | None, config: Config = Config()) -> str:
    return "\n".join(b.text for b in content(blocks(html or ""), config))


def extract(pages: DataFrame, config: Config = Config(), key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""

    def step(keys, urls, pages) -> Iterator[tuple]:
        for k, u, page in zip(keys, urls, pages, strict=True):
            text = main_text(page, config)
            yield k, u, text, len(text)

    rows = pages.select(F.col(key), F.col(url), F.col(html).cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in (key, url)]
    return map_rows(rows, [key, url, "html"], f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long", step)
