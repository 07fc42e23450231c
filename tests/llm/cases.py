"""Rows with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, doc string, n_words long, kept boolean, fail_bits long,"
    " chunk int, part int, spans string, items string, component long, rep long, row string"
)

PASSAGE = " ".join(f"pass{i}" for i in range(60))
LONG = " ".join(f"w{i * i % 997} ist über{i % 13}," for i in range(9000))


def _text(seed: int, n: int) -> str:
    return " ".join(f"t{(seed * 7919 + i * i * 31) % 5003}" for i in range(n))


TEXTS = [
    None,
    "",
    "   \n\t ",
    "one two",
    "...",
    _text(1, 80),
    _text(1, 80),
    _text(1, 80).replace("t31 ", "T31 ") + " end",
    _text(2, 50) + " " + PASSAGE + " " + _text(3, 20),
    _text(4, 30) + "\n" + PASSAGE,
    "a " * 40,
    "a a a a a a a a a a a a a b",
    LONG,
    LONG,
    _text(5, 12) + " item words that stand in the benchmark only once or twice in all of it " + _text(6, 12),
    "same line here now\nsame line here now\nother words follow here and end",
    "é ü ß 你好 🙂 x1_y2 don't STOP   three  spaces   end\r\nnext",
    "Licensed under CC BY-NC 4.0. ALL RIGHTS reserved; all rights reserved. General, Public License!",
    "This work is licensed under the old GNU General Public License, version 3.",
]
IDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None, 15, 16, 17, 18, 19]


def rows():
    out = []
    for i, t in zip(IDS, TEXTS):
        out.append((i, t, None if i == 4 else "en", None if i == 5 else "s", None, "x", 7, None, 3, 1, None, "s", None, 5, None, "r"))
    return [*out, out[5], out[8]]  # repeated rows


ITEMS = [(1, "Item words that STAND in the benchmark only once, or twice in all!"), (2, "stop"), (3, None), (4, ""), (4, "stop"), (None, "spaces"), (10, "zzz not there at all")]


def white(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def passages(docs, window=13):
    """(doc_id, n_words, n_removed, kept text) of each row."""
    big = float("inf")
    least = {}
    for i, t in docs:
        w = white(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, big), big if i is None else i)
    out = []
    for i, t in docs:
        w, gone = white(t), set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (big if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def near(docs, width, percent):
    """doc_id -> (component, kept) by all pairs."""
    sets = {}
    for i, t in docs:
        w = white(lower(t))
        if i is not None:
            sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    ids, up = sorted(sets), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def quality(text):
    w, n = white(text), 5
    many = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    again = {p for k in range(len(w) - n + 1) if many[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
    lines = [x for x in (text or "").split("\n") if white(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def contaminated(text, items, window=10):
    """(n_words, n_hit, item ids) of a text."""
    w, hit, ids = letters(text), set(), set()
    for i, t in items:
        own = letters(t)
        size = min(window, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(w) - size + 1 if own else 0):
            if tuple(w[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                if i is not None:
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)
