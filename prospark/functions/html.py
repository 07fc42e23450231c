"""Small HTML readers for use inside tasks, one page at a time."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from prospark import rules

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article blockquote dd div dl dt fieldset figure figcaption main ol p pre section table tbody td tfoot th "
    "thead tr ul li h1 h2 h3 h4 h5 h6".split()
)
_MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}
_DROPPED = frozenset(rules.DROPPED_TAGS) | {"head"}


class _Reader(HTMLParser):
    """Keeps the stack of open tags; unclosed tags end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []

    def opened(self, tag, attrs):
        pass

    def closed(self, tag):
        pass

    def handle_starttag(self, tag, attrs):
        self.opened(tag, {k: v or "" for k, v in attrs})
        if tag in _VOID:
            self.closed(tag)
        else:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack:
                top = self.stack.pop()
                self.closed(top)
                if top == tag:
                    break


class _TextReader(_Reader):
    """Page copy as plain Markdown: headings, bullets, links and emphasis."""

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.hidden_from: int | None = None
        self.links: list[tuple[int, str]] = []
        self.marks: list[int] = []

    def _hides(self, tag, attrs) -> bool:
        if tag in _DROPPED or attrs.get("role", "").lower() in rules.DROPPED_ROLES:
            return True
        named = f"{attrs.get('id', '')} {attrs.get('class', '')}".lower()
        return any(m in named for m in rules.DROPPED_MARKERS)

    def opened(self, tag, attrs):
        if self.hidden_from is not None:
            return
        if self._hides(tag, attrs):
            if tag not in _VOID:
                self.hidden_from = len(self.stack)
            return
        if tag in _BLOCKS:
            self.out.append("\n" if tag in ("li", "tr", "dt", "dd") else "\n\n")
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("#" * int(tag[1:]) + " ")
        elif tag == "li":
            self.out.append("* ")
        elif tag == "blockquote":
            self.out.append("> ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "a":
            self.links.append((len(self.out), attrs.get("href", "")))
        elif tag in _MARKS:
            self.marks.append(len(self.out))

    def closed(self, tag):
        if self.hidden_from is not None:
            if len(self.stack) <= self.hidden_from:
                self.hidden_from = None
            return
        if tag == "a" and self.links:
            start, href = self.links.pop()
            text = " ".join("".join(self.out[start:]).split())
            del self.out[start:]
            if text:
                self.out.append(f"[{text}]({href})" if href else text)
        elif tag in _MARKS and self.marks:
            start = self.marks.pop()
            if "".join(self.out[start:]).strip():  # no marks around nothing
                self.out.insert(start, _MARKS[tag])
                self.out.append(_MARKS[tag])
        elif tag in _BLOCKS:
            self.out.append("\n" if tag in ("li", "tr", "dt", "dd") else "\n\n")

    def handle_data(self, data):
        if self.hidden_from is None:
            self.out.append(data if "pre" in self.stack else re.sub(r"\s+", " ", data))


def page_copy(html: str | None) -> str:
    """Business copy of a page without navigation, forms and banners."""
    if not html or not html.strip():
        return ""
    reader = _TextReader()
    reader.feed(html)
    reader.close()
    lines = [line.strip() for line in "".join(reader.out).splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


class _HeadReader(_Reader):
    def __init__(self):
        super().__init__()
        self.title: list[str] | None = None
        self.description = self.canonical = self.language = None
        self.open_graph: dict[str, str] = {}
        self.first_graph: dict[str, str] = {}
        self.seen_html = False

    def opened(self, tag, attrs):
        if tag == "html" and not self.seen_html:
            self.seen_html = True
            self.language = attrs.get("lang", "").strip() or None
        elif tag == "title" and self.title is None:
            self.title = []
        elif tag == "meta":
            content, prop = attrs.get("content", "").strip(), attrs.get("property", "")
            if attrs.get("name", "").lower() == "description" and self.description is None:
                self.description = content
            if prop.lower().startswith("og:"):
                self.first_graph.setdefault(prop, content)
                if content:
                    self.open_graph[prop.lower()] = content
        elif tag == "link" and self.canonical is None and "canonical" in attrs.get("rel", "").lower().split():
            self.canonical = attrs.get("href", "").strip()

    def handle_data(self, data):
        if self.stack and self.stack[-1] == "title" and self.title is not None:
            self.title.append(data)

    def result(self) -> dict:
        title = "".join(self.title or [])
        return {
            "title": title.strip() if title else self.first_graph.get("og:title") or None,
            "description": self.description or self.first_graph.get("og:description") or None,
            "canonical_url": self.canonical or None,
            "language": self.language,
            "open_graph": self.open_graph,
        }


def head_facts(html: str | None) -> dict:
    """Title, description, canonical URL, language and OpenGraph pairs of a page."""
    reader = _HeadReader()
    reader.feed(html or "")
    reader.close()
    return reader.result()
