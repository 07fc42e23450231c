"""A page as a tree of block elements with features per element."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# Elements of the HTML standard by their role.
RAW = "script|style|template|svg|noscript|iframe|textarea|title|object|canvas|math"
_TO_END = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr td th"
    " form fieldset label button select option blockquote pre figure figcaption details summary dialog address center menu head".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KINDS = {
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset label button select option",
    "article": "article main", "box": "div section details center", "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol li dl dt dd",
    "table": "table thead tbody tfoot tr td th", "quote": "blockquote pre figure figcaption",
}
_TOKENS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs toolbar",
    "ad": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion dfp outbrain taboola",
    "notice": "cookie cookies consent notice gdpr privacy popup modal overlay alert newsletter subscribe subscription signup paywall login",
    "comment": "comment comments reply replies respond discussion disqus responses reader",
    "chrome": "header footer sidebar side aside masthead topbar widget related recommended share sharing social tags meta copyright hidden search logo rail trending popular",
    "content": "content article post entry body main story text page single",
}
KINDS, TOKENS = list(_KINDS), list(_TOKENS)
_KIND = {tag: i for i, k in enumerate(KINDS) for tag in _KINDS[k].split()}
_TOKEN = {t: i for i, k in enumerate(TOKENS) for t in _TOKENS[k].split()}

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/])(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*?/>"
    rf"|<({RAW})(?=[\s/>])[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z!?][^>]*+(?:>|\Z)|([^<]++)|(<)",
    re.S | re.I,
)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW.split("|")}
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_STOPS = re.compile(r"[.,;:!?]")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Words that make a class name say what its page has or how it stands, and not what the element is.
_STATES = frozenset("has is no not with without open opened closed fixed sticky enabled disabled on off in out free active layout logged xs sm md lg xl left right".split())
JUNK = ["nav", "ad", "notice", "comment", "chrome"]


@dataclass
class Page:
    """Elements in page order (element 0 is the page) and text segments, each with the element it stands in."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    kind: list[int] = field(default_factory=lambda: [-1])
    tokens: list[int] = field(default_factory=lambda: [0])
    owner: list[int] = field(default_factory=list)
    segments: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    keep: list[str | None] = field(default_factory=lambda: [None])


def _attribute_tokens(attributes: str) -> tuple[int, str | None]:
    """Groups of the words in class, id, role and the like as bits; the example mark `data-keep`."""
    bits, keep = 0, None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
            for one in value.split():
                words = [w.lower() for w in _SPLIT.split(one)]
                if _STATES.isdisjoint(words):
                    for w in words:
                        at = _TOKEN.get(w)
                        if at is not None:
                            bits |= 1 << at
        elif name == "data-keep":
            keep = value
        elif name == "hidden" and value.lower() != "false" or name == "style" and _UNSEEN.search(value):
            bits |= 1 << TOKENS.index("notice")
    return bits, keep


def _pieces(source: str) -> Iterator[re.Match]:
    """Pieces of a page without the content of raw elements.

    A raw element without an end tag is its tag alone, if the HTML standard does not let it run to the end of the page.
    """
    at, unclosed = 0, set()
    while at < len(source):
        for m in _PIECE.finditer(source, at):
            at = m.end()
            yield m
            if m[1] is None:
                continue
            name = m[1].lower()
            end = None if name in unclosed else _ENDS[name].search(source, at)
            if end is not None:
                at = end.end()
                break
            if name in _TO_END:
                return
            unclosed.add(name)


def parse(source: str) -> Page:
    page = Page()
    stack, names, opened = [0], [""], Counter()
    links, text, chars = 0, [], 0

    def close() -> None:
        opened[names.pop()] -= 1
        stack.pop()

    def flush() -> None:
        nonlocal chars
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                page.segments.append(whole)
                page.owner.append(stack[-1])
                page.linked.append(min(chars, len(whole)))
            text.clear()
        chars = 0

    for m in _pieces(source):
        words, tag = m[5] or m[6], m[3]
        if words is not None:
            text.append(words)
            if links:
                chars += len(words.strip())
            continue
        if tag is None:
            if m[1] is None and not m[0].startswith("<!"):
                continue
            if m[1] is not None:
                flush()
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m[2] else 1
        elif tag == "br" or tag == "hr":
            flush()
        elif tag in BLOCK:
            flush()
            if m[2]:
                if opened[tag]:
                    while names[-1] != tag:
                        close()
                    close()
                links = 0
                continue
            if names[-1] == "p" or names[-1] in _CLOSES.get(tag, ()):
                close()
            bits, keep = _attribute_tokens(m[4]) if m[4] else (0, None)
            page.parent.append(stack[-1])
            page.depth.append(len(stack))
            page.kind.append(_KIND.get(tag, -1))
            page.tokens.append(bits)
            page.keep.append(keep)
            if not m[4].endswith("/") or tag == "p":
                stack.append(len(page.parent) - 1)
                names.append(tag)
                opened[tag] += 1
    flush()
    return page


FEATURES = [
    "depth", "chars", "link_share", "elements", "chars_per_element", "place", "share", "sibling_place", "siblings", "sibling_share", "stops", "own_chars",
    *[f"is_{k}" for k in KINDS], *[f"in_{k}" for k in KINDS], *[f"has_{k}" for k in TOKENS], *[f"under_{k}" for k in TOKENS],
    "junk_share", "junk_titled", "content_nearer", "beside_text", "titles_before", "p_share",
]


def features(page: Page) -> np.ndarray:
    """Elements x features. Subtree sums run from the last element to the first, inherited marks the other way.

    A junk word above an element says little if what it marks is most of the page or has the page's title: `junk_share`
    and `junk_titled` tell of the nearest marked element, and `content_nearer` whether a content word stands below it.
    """
    n = len(page.parent)
    own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for o, s, k in zip(page.owner, page.segments, page.linked):
        own[o] += len(s)
        linked[o] += k
        stops[o] += len(_STOPS.findall(s))
    chars, links, ends, below = own.copy(), linked.copy(), stops.copy(), np.ones(n)
    parent = page.parent
    order: list[int] = [0] * n
    children = [0] * n
    for i in range(1, n):
        order[i] = children[parent[i]]
        children[parent[i]] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        ends[p] += ends[i]
        below[p] += below[i]
    up = np.array(parent)
    up[0] = 0
    kind, token = np.array(page.kind), np.array(page.tokens)
    is_kind = (kind[:, None] == np.arange(len(KINDS))).astype(float)
    has = ((token[:, None] >> np.arange(len(TOKENS))) & 1).astype(float)
    inside, under = is_kind.copy(), has.copy()
    for i in range(1, n):
        p = parent[i]
        np.maximum(inside[i], inside[p], out=inside[i])
        np.maximum(under[i], under[p], out=under[i])
    before = np.concatenate(([0], np.cumsum(own)[:-1]))
    total = max(chars[0], 1.0)
    title = kind == KINDS.index("heading")
    title[1:] &= ~title[np.maximum(up[1:], 0)]
    first_title = np.flatnonzero(title)[:1]
    titled = np.zeros(n, dtype=bool)
    for i in first_title.tolist():
        while i > 0:
            titled[i] = True
            i = parent[i]
    titled[0] = len(first_title) > 0
    junk = has[:, [TOKENS.index(k) for k in JUNK]].any(axis=1)
    content = has[:, TOKENS.index("content")].astype(bool) | (kind == KINDS.index("article"))
    near, nearer = [-1] * n, [False] * n
    for i in range(1, n):
        p = parent[i]
        near[i], nearer[i] = (i, False) if junk[i] and not content[i] else (near[p], nearer[p] or bool(content[i]))
    near = np.array(near)
    junk_share = np.where(near >= 0, chars[near] / total, 0.0)
    junk_titled = np.where(near >= 0, 1.0 + titled[near], 0.0)
    paragraphs = np.where(kind == KINDS.index("p"), chars, 0.0)
    beside = np.zeros(n)
    np.add.at(beside, up[1:], paragraphs[1:])
    more = np.stack([junk_share, junk_titled, np.array(nearer, dtype=float), beside[up] / total, np.cumsum(title) - title, beside / np.maximum(chars, 1)], axis=1)
    siblings = np.array(children)[up]
    plain = np.stack(
        [
            np.array(page.depth), np.log1p(chars), links / np.maximum(chars, 1), np.log1p(below), np.log1p(chars / below), before / total, chars / total,
            np.array(order) / np.maximum(siblings, 1), np.log1p(siblings), chars / np.maximum(chars[up], 1), ends / np.maximum(chars, 1), np.log1p(own),
        ],
        axis=1,
    )
    return np.concatenate([plain, is_kind, inside, has, under, more], axis=1)
