"""Main text of pages written by hand, in shapes that no generator made."""

import time

import pytest

from prospark.llm import dom, maintext

LINES = [f"Sentence {k} stands here in the text of this page, and it goes on for quite a while; nothing of it is junk. It says more about the same thing, then it says some more, so that a reader has something to read and the line grows as long as lines are wont to be." for k in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)
HEAD = "<h1>A title of the page</h1>"
WANT = " ".join(["A title of the page", *LINES])
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav>'
FOOT = "<footer><p>Copyright 2024 Someone. All rights reserved.</p></footer>"
LINKED = "".join(f'<p><a href="/x">{x[:18]}</a>{x[18:]}</p>' for x in LINES)
COMMENTS = '<section id="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with a word of this, and I have read it twice by now.</p></div><div class="comment"><p>Well said, thank you.</p></div></section>'

PAGES = {
    "paragraphs in the body": f"<body>{HEAD}{BODY}</body>",
    "between menu and footer": f"<body>{NAV}{HEAD}{BODY}{FOOT}</body>",
    "states in class names": f'<body>{NAV}<div class="single-post comments-open has-sidebar"><article class="post">{HEAD}{BODY}</article></div>{FOOT}</body>',
    "hidden and header in class names": f'<body>{NAV}<div id="page" class="hidden-sm header-fixed"><div class="entry">{HEAD}{BODY}</div></div>{FOOT}</body>',
    "junk words on the outer element": f'<body><div id="sidebar-layout" class="header widget-area">{NAV}<div>{HEAD}{BODY}</div>{FOOT}</div></body>',
    "table": f"<body><table><tr><td colspan=2>{NAV}</td></tr><tr><td><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></td><td>{HEAD}{BODY}</td></tr><tr><td colspan=2>{FOOT}</td></tr></table></body>",
    "paragraphs that begin with a link": f"<body>{NAV}<div>{HEAD}{LINKED}</div>{FOOT}</body>",
    "comments below": f"<body>{NAV}<main>{HEAD}{BODY}</main>{COMMENTS}{FOOT}</body>",
    "comments in the article's wrapper": f'<body class="single logged-in">{NAV}<div id="content"><div class="post">{HEAD}{BODY}</div>{COMMENTS}</div>{FOOT}</body>',
    "old page": f"<html><body bgcolor=white><center><font size=2><a href=/>Home</a> | <a href=/b>Blog</a></font></center><hr>{HEAD}{BODY}</body></html>",
}


@pytest.mark.parametrize("shape", PAGES)
def test_articles_are_kept(shape):
    got = maintext.main_texts(maintext.default_trees(), [PAGES[shape]])[0]
    kept = sum(x in got for x in LINES)
    assert kept == len(LINES), got
    assert len(got) >= 0.95 * len(WANT) and not any(x in got for x in ("Copyright", "Blog |", "agree", "Well said", "Two"))


@pytest.mark.parametrize(
    "attributes, hidden",
    [('class="hidden-sm"', False), ("hidden", True), ('hidden=""', True), ('hidden="false"', False), ('style="color:red; display : none"', True), ('data-x="display:none"', False), ('aria-hidden="true"', False), ('id=a hidden class=b', True)],
)
def test_hidden_is_an_attribute(attributes, hidden):
    bits, _ = dom._attribute_tokens(" " + attributes)
    assert bool(bits >> dom.TOKENS.index("notice") & 1) == hidden


def test_hostile_nesting_is_linear():
    """Many open elements and end tags of elements that are not open."""
    took = []
    for n in (10_000, 40_000):
        source = "<div>" * n + "</section>" * n + "<p>x" + "</div>" * n
        start = time.process_time()
        page = dom.parse(source)
        took.append(time.process_time() - start)
        assert len(page.parent) == n + 2 and page.segments == ["x"]
    assert took[1] < 12 * max(took[0], 0.02)
    start = time.process_time()
    maintext.main_texts(maintext.default_trees(), ["<div>" * 100_000 + "</section>" * 100_000 + "x"])
    assert time.process_time() - start < 20


def test_very_long_pages():
    text = maintext.main_texts(maintext.default_trees(), [f"<body>{NAV}<article>{HEAD}{BODY * 400}</article>{FOOT}</body>"])[0]
    assert text == "A title of the page " + " ".join(LINES * 400)
