"""Main text of web pages by gradient-boosted trees over DOM elements.

Every block element gets features of its subtree (text, links, density), its tag and attribute words and those of its
ancestors, its depth and its place among its siblings. Boosted trees give each element the log-odds of being article.
Decoding is hierarchical: from the leaves up, an element either goes with everything below it, or stays and its
children are decided by themselves, whichever has the larger sum of weighted log-odds. So nothing inside a dropped
element is kept and no kept element stands in a dropped one.

The trees are fitted on pages composed by rule from labelled parts (`example_pages`, EXAMPLES pages, a fixed bound);
pages to extract are not needed for fitting, and each page is extracted inside a task without exchange.

Defined cases: null or empty html, or a page without article text, gives the empty text; null url or page_id stay
null; repeated rows are extracted one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospark.llm.dom import FEATURES, Page, features, parse

EXAMPLES, TREES, DEPTH, RATE, BINS = 800, 50, 5, 0.3, 32


@dataclass
class Trees:
    """Complete binary trees: `feature` and `cut` of inner nodes level by level, `leaf` values in log-odds."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = TREES) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    size, inner = x.shape[1], 2**DEPTH - 1
    bins = [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]
    cuts = np.full((size, BINS), np.inf)
    for f, e in enumerate(edges):
        cuts[f, : len(e)] = e
    rate = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    score = np.full(len(x), base)
    all_features, all_cuts, all_leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            # One count per feature gives its histograms in all nodes of the level.
            place = [(at - first) * BINS + b for b in bins]
            gl, hl = (np.stack([np.bincount(k, weights=v, minlength=nodes * BINS).reshape(nodes, BINS) for k in place], axis=1).cumsum(axis=2) for v in (g, h))
            gs, hs = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[:, ~np.isfinite(cuts)] = 0
            many = np.bincount(at - first, minlength=nodes)
            for node in range(nodes):
                f, k = divmod(int(gain[node].argmax()), BINS)
                if many[node] >= 20 and gain[node, f, k] > 1e-3:
                    feature[first + node], cut[first + node] = f, cuts[f, k]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        at -= inner
        leaf = -RATE * np.bincount(at, weights=g, minlength=inner + 1) / (np.bincount(at, weights=h, minlength=inner + 1) + 1)
        score += leaf[at]
        all_features.append(feature)
        all_cuts.append(cut)
        all_leaves.append(leaf)
    return Trees(base, np.array(all_features), np.array(all_cuts), np.array(all_leaves))


def example_pages(n: int = EXAMPLES, seed: int = 1) -> list[str]:
    """Pages composed from labelled parts: `data-keep` says of an element and all below it whether it is article."""
    rng, letters = np.random.default_rng(seed), np.array(list("abcdefghilmnoprstu"))
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def words(a: int, b: int) -> str:
        ends = np.cumsum(rng.integers(2, 9, rng.integers(a, b + 1)))
        drawn = "".join(letters[rng.integers(0, len(letters), ends[-1])])
        out = [drawn[x:y] for x, y in zip([0, *ends.tolist()], ends.tolist())]
        for i in range(7, len(out), 9):
            out[i] += pick(".", ",", ";")
        return " ".join(out).capitalize() + pick(".", ".", "")

    def links(a: int, b: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.integers(a, b + 1)))

    def name(*xs: str) -> str:
        return f' {pick("class", "class", "id")}="{pick(*xs)}"'

    def linked(text: str) -> str:
        """The text with a link at its start, at its end or round all of it."""
        at = int(rng.integers(1, 60))
        return pick(f'<a href="/x">{text[:at]}</a>{text[at:]}', f'<a href="/x">{text[:at]}</a>{text[at:]}', f'{text[:at]}<a href="/x">{text[at:]}</a>', f'{text[:at]}<a href="/x">{text[at:at + 20]}</a>{text[at + 20:]}')

    def paragraph(text: str) -> str:
        return f"<p>{linked(text) if rng.random() < with_links else text}" + ("</p>" if rng.random() < 0.9 else "")

    def prose() -> list[str]:
        tags = [paragraph(words(1, 80)) for _ in range(rng.integers(1, 9))]
        if rng.random() < 0.3:
            tags.append(pick(f"<blockquote><p>{words(8, 30)}</p></blockquote>", f"<ul><li>{words(2, 15)}</li><li>{words(2, 15)}</li></ul>", f"<h2>{words(2, 6)}</h2><p>{words(9, 50)}</p>", f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>", f"<pre>{words(5, 20)}</pre>", f"<figure><figcaption>{words(3, 12)}</figcaption></figure>"))
        rng.shuffle(tags)
        if rng.random() < 0.2:
            tags.insert(int(rng.integers(len(tags) + 1)), junk(pick("ad", "notice", "share", "related", "form", "aside", "footer", "comments")))
        return tags

    def state() -> str:
        """Attributes of a wrapper that name parts of the page without being one."""
        about = ["sidebar", "comments", "nav", "menu", "header", "footer", "ads", "search", "cookie", "social", "hidden", "widget", "related"]
        names = [pick("has-{}", "{}-open", "with-{}", "no-{}", "{}-fixed", "{}-layout", "{}-page", "{}-wrap", "{}-area", "js-{}", "{}", "theme-{}-2").format(pick(*about)) for _ in range(rng.integers(1, 4))]
        names += [pick("page", "site", "wrapper", "container", "single-post", "row", "col-8", "content")] if rng.random() < 0.7 else []
        rng.shuffle(names)
        return f' {pick("class", "class", "id")}="{" ".join(names)}"'

    def marked(tag: str) -> str:
        """A part of an article that stands without a common element around it."""
        return tag if "data-keep" in tag.split(">", 1)[0] else tag.replace(">", ' data-keep="yes">', 1)

    def junk(kind: str) -> str:
        text, no = words(1, 40), ' data-keep="no"'
        if kind == "nav":
            return pick(f"<nav{no}><ul>{links(3, 9)}</ul></nav>", f"<div{no}{name('menu', 'main-nav', 'breadcrumbs', 'pagination')}><ul>{links(2, 8)}</ul></div>", f"<ul{no}{name('menu', 'navbar')}>{links(3, 8)}</ul>")
        if kind == "header":
            return pick(f"<header{no}><p>{words(1, 12)}</p></header>", f"<header{no}><h1>{words(1, 5)}</h1><ul>{links(0, 5)}</ul></header>", f"<div{no}{name('header', 'masthead', 'topbar', 'site-header')}>{words(1, 10)}</div>", f"<header{no}>{words(1, 9)}</header>")
        if kind == "footer":
            return pick(f"<footer{no}>&copy; {text}</footer>", f"<footer{no}><p>{text}</p><ul>{links(0, 5)}</ul></footer>", f"<div{no}{name('footer', 'site-footer', 'copyright')}><p>{text}</p></div>")
        if kind == "aside":
            return pick(f"<aside{no}><h3>{words(1, 4)}</h3><p>{text}</p></aside>", f"<aside{no}><ul>{links(2, 7)}</ul></aside>", f"<div{no}{name('sidebar', 'side-rail', 'widget')}><h3>{words(1, 4)}</h3><p>{text}</p></div>", f"<aside{no}>{text}</aside>")
        if kind == "ad":
            return pick(f"<div{no}{name('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo-box')}>{text}</div>", f"<div{no}{name('advertisement', 'ad', 'banner')}><p>{text}</p></div>", f"<section{no}{name('ad', 'sponsor')}><p>{text}</p></section>", f"<p{no}{name('ad', 'promo')}>{text}</p>")
        if kind == "notice":
            return pick(f"<div{no}{name('cookie-notice', 'cookie-consent', 'notice', 'gdpr', 'popup', 'newsletter', 'alert')}><p>{text}</p></div>", f"<div{no}{name('cookie', 'consent-banner', 'notice')}>{text}<button>{words(1, 2)}</button></div>", f"<p{no}{name('notice', 'cookie')}>{text}</p>", f"<div{no} hidden><p>{text}</p></div>", f"<section{no}{name('notice', 'subscribe')}><p>{text}</p></section>")
        if kind == "form":
            return pick(f"<form{no}><label>{words(1, 5)}</label><button>{words(1, 2)}</button></form>", f"<form{no}{name('search', 'subscribe', 'contact')}><p>{text}</p><button>{words(1, 2)}</button></form>", f"<form{no}>{text}</form>")
        if kind == "comments":
            own = "".join(pick(f"<div class=\"comment\"><p>{words(2, 60)}</p></div>", f"<li class=\"comment\">{words(2, 60)}</li>", f"<p>{words(3, 60)}</p>", f"<article><p>{words(3, 60)}</p></article>") for _ in range(rng.integers(1, 6)))
            return f"<{pick('section', 'div', 'ul', 'ol')}{no}{name('comments', 'comment-list', 'reader-comments', 'discussion', 'respond')}><h3>{words(1, 3)}</h3>{own}</div></section></ul></ol>"
        if kind == "share":
            return f"<div{no}{name('share', 'social', 'tags')}><ul>{links(1, 5)}</ul></div>"
        return f"<{pick('div', 'section')}{no}{name('related', 'recommended', 'popular', 'trending')}><h3>{words(1, 4)}</h3><ul>{links(2, 6)}</ul></div></section>"

    pages = []
    for _ in range(n):
        with_links = pick(0.0, 0.0, 0.1, 0.6)
        title = f"<h1>{words(1, 9)}</h1>" if rng.random() < 0.8 else ""
        if title and rng.random() < 0.15:
            title = f"<header>{title}</header>"
        parts = ([title] if title else []) + prose()
        head = [junk(k) for k in ("nav", "header", "notice", "ad", "form", "aside") if rng.random() < 0.4]
        tail = [junk(k) for k in ("comments", "related", "share", "aside", "ad", "form", "notice", "nav", "footer") if rng.random() < 0.35]
        rng.shuffle(head)
        yes, form = ' data-keep="yes"', rng.random()
        if form < 0.25:
            whole = "".join(marked(t) for t in parts)
        elif form < 0.35:
            side = [f"<td>{junk(pick('nav', 'aside', 'related', 'ad'))}</td>" if rng.random() < 0.6 else "" for _ in range(2)]
            cell = f"<td{yes}>{''.join(parts)}</td>" if rng.random() < 0.6 else f"<td>{''.join(marked(t) for t in parts)}</td>"
            rows = [f"<tr><td colspan=3>{junk(k)}</td></tr>" if rng.random() < 0.5 else "" for k in ("header", "footer")]
            whole = f"<table>{rows[0]}<tr>{side[0]}{cell}{side[1]}</tr>{rows[1]}</table>"
        else:
            tag, extra = pick(("article", ""), ("article", ""), ("main", ""), ("div", name("content", "post", "entry-content", "article-body", "story", "main")), ("section", name("content", "article", "story")), ("div", ""))
            whole = f"<{tag}{yes}{extra}>{''.join(parts)}</{tag}>"
        if rng.random() < 0.3:
            inside = junk("comments") if rng.random() < 0.5 else junk(pick("ad", "share", "related", "aside", "nav"))
            outer = pick("main", "div", 'div class="page"', 'div id="wrapper"')
            whole = f"<{outer}>{whole}{inside}</{outer.split()[0]}>"
        for _ in range(2):
            if rng.random() < 0.3:
                tag = pick("div", "div", "section")
                whole = f"<{tag}{state()}>{whole}</{tag}>"
        page = "".join(head) + whole + "".join(tail)
        if rng.random() < 0.3:
            page = f"<div{state()}>{page}</div>"
        pages.append(f"<html><body{state() if rng.random() < 0.2 else ''}>{page}</body></html>")
    return pages


def _labels(page: Page) -> np.ndarray:
    """1 article, 0 not, -1 unknown: the nearest mark above decides."""
    out = np.full(len(page.parent), -1)
    for i, keep in enumerate(page.keep):
        out[i] = {"yes": 1, "no": 0}.get(keep, out[page.parent[i]] if i else -1)
    return out


@functools.cache
def default_trees(examples: int = EXAMPLES) -> Trees:
    xs, ys = [], []
    for source in example_pages(examples):
        page = parse(source)
        label = _labels(page)
        xs.append(features(page)[label >= 0])
        ys.append(label[label >= 0])
    x, y = np.concatenate(xs), np.concatenate(ys)
    # Text elements weigh with their text, so that a page of many menu lines doesn't outweigh its article.
    return fit(x, y.astype(float), 1 + x[:, FEATURES.index("chars")])


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """True for elements that stay: an element stays if it and the best choice below it sum up above zero."""
    own = np.zeros(len(score))
    for o, s in zip(page.owner, page.segments):
        own[o] += len(s)
    value = score * np.sqrt(own)
    best, parent = value.copy(), page.parent
    for i in range(len(best) - 1, 0, -1):
        best[parent[i]] += max(0.0, best[i])
    keep = np.zeros(len(best), dtype=bool)
    keep[0] = best[0] > 0
    for i in range(1, len(best)):
        keep[i] = keep[parent[i]] and best[i] > 0
    return keep


def main_texts(trees: Trees, sources: list[str]) -> list[str]:
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    x = [features(p) for p in pages]
    ends = np.cumsum([len(f) for f in x])
    score = trees.score(np.concatenate(x))
    out = []
    for page, f, end in zip(pages, x, ends):
        keep = decode(page, score[end - len(f) : end])
        out.append(" ".join(s for s, o in zip(page.segments, page.owner) if keep[o]))
    return out


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees or default_trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                texts = main_texts(shared.value, [h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
