"""Token counts, conversation repair and fill-in-middle against the library, brute force and exact round trips."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prospark.llm import counts, fim, repair
from prospark.llm.op12_repair import damaged
from tests.llm import cases
from tests.llm.test_operators import PAIRS, bag

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.rows(), cases.SCHEMA)


@pytest.fixture(scope="module")
def counter():
    return counts.Counter(counts.Vocabulary(open(MODEL, "rb").read()))


# Token counts


def test_counts_of_awkward_rows(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = counts.count_tokens(docs, MODEL, limit=50).selectExpr("doc.doc_id", "doc.chunk", "n_bytes", "n_tokens", "over_limit").collect()
    want = []
    for r in cases.rows():
        n = len(lib.encode(r[1] or ""))
        want.append((r[0], 1, len((r[1] or "").encode()), n, n > 50))
    assert bag(map(tuple, got)) == bag(want)
    assert counts.count_tokens(docs.limit(0), MODEL).count() == 0


WORDS = ["a", "b", "th", "he", "t", " ", "  ", " " * 17, "\n", "\t", "é", "é", "你", "好", "🙂", "aa", "aaaa", "▁", "12", "<s>", "<0x41>", "\u0000", "ing", "==", "----", "ʻ", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=60).map("".join), max_size=6))
def test_counts_are_those_of_the_library(counter, texts):
    assert counter(texts).tolist() == [len(x) for x in counter.vocabulary.library.encode(texts)]


def test_long_pretokens_and_many_rounds(counter):
    lib, rng = counter.vocabulary.library, random.Random(5)
    long = ["a" * 30_000, " " * 9_000, "".join(rng.choice("acgt") for _ in range(20_000)), "".join(rng.choice("ation") for _ in range(4_000)), "好" * 5_000, "🙂" * 3_000]
    assert counter(long).tolist() == [len(x) for x in lib.encode(long)]
    for text in long:
        s = counter.vocabulary.of_char[np.frombuffer(lib.normalize(text[:3_000]).encode("utf-32-le"), dtype=np.uint32)]
        s = s[s >= 0]
        assert counts.count_merged(counter.vocabulary, s, np.array([len(s)]))[0] == counts.count_long(counter.vocabulary, s)


def test_counts_with_a_full_store(counter, monkeypatch):
    monkeypatch.setattr(counts, "KEPT_PIECES", 10)
    own = counts.Counter(counter.vocabulary)
    for _ in range(2):
        assert own([cases.LONG, "a b c"]).tolist() == [len(x) for x in counter.vocabulary.library.encode([cases.LONG, "a b c"])]
    assert len(own.known) == 10


# Conversation repair

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SHAPE = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def ways(row, fault):
    _, role, text = row
    late = 5 if fault == "truncated" else 0
    out = [(2, "D", None)]
    if fault not in ("blank", "duplicate"):
        out += [(late, "K", (role, text)), (1 + late, "R", ("user", text)), (1 + late, "R", ("assistant", text))]
    return out


def every_repair(rows):
    """The least (cost, audit, lines) of all edit sequences with at most two insertions at a place."""
    inserts = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for edits in itertools.product(*(ways(r, f) for r, f in zip(rows, faults(rows)))):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for k, more in enumerate(put):
                cost, audit = cost + 5 * len(more), audit + "I" * len(more)
                lines += [(r, "") for r in more]
                if k < len(rows):
                    c, letter, line = edits[k]
                    cost, audit = cost + c, audit + letter
                    lines += [line] if line else []
            if SHAPE.fullmatch("".join(r[:1] or "?" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def plain_repair(rows):
    """The same by a table of rows and states that holds whole audits."""
    best = {0: (0, "", [])}

    def inserted(table):
        out = dict(table)
        for _ in range(2):
            for q, (c, a, lines) in list(out.items()):
                x = "a" if q == 2 else "u"
                way = (c + 5, a + "I", [*lines, ("user" if x == "u" else "assistant", "")])
                if NEXT[q][x] not in out or way[:2] < out[NEXT[q][x]][:2]:
                    out[NEXT[q][x]] = way
        return out

    for row, fault in zip(rows, faults(rows)):
        new = {}
        for q, (c, a, lines) in best.items():
            # Insertions before the row from this state alone, so that audits are compared only once they are whole.
            for t, (c2, a2, l2) in inserted({q: (c, a, lines)}).items():
                for cost, letter, line in ways(row, fault):
                    to = t if line is None else NEXT[t].get(line[0][:1])
                    if to is None:
                        continue
                    way = (c2 + cost, a2 + letter, [*l2, line] if line else l2)
                    if to not in new or way[:2] < new[to][:2]:
                        new[to] = way
        best = new
    ends = [w for q, w in best.items() if q in (0, 3)]
    ends += [inserted({q: w})[3] for q, w in best.items() if q in (1, 2)]
    return min(ends, key=lambda w: w[:2])


def expected(rows):
    """All columns of the report for the rows of one conversation, in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", cases.sha(b""))
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = plain_repair(rows)
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, cases.sha("\n".join(f"{r}:{t}" for r, t in lines).encode()))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def random_rows(rng, n, roles=("system", "user", "assistant", "user", "assistant", "tool", "", " ", "u2")):
    texts = ["Yes.", "No!", "cut off", " \n", "", "What?", "what ", "Long one. ", "odd"]
    return [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts) + rng.choice(["", "", str(rng.randrange(9)) + "."])) for _ in range(n)]


def test_brute_force_versions_agree():
    rng = random.Random(2)
    for n in (0, 1, 2, 2, 3, 3):
        for _ in range(12 if n < 3 else 3):
            rows = in_order(random_rows(rng, n))
            assert plain_repair(rows)[:2] == every_repair(rows)[:2]


def reports(spark, rows, conv_type="long"):
    df = spark.createDataFrame(rows, f"conv_id {conv_type}, turn long, role string, text string, n long")
    got = repair.report(repair.repaired(df)).selectExpr("conv.id", "gaps", "blank", "duplicate", "truncated", "illegal", "total", "audit", "repaired_sha256").collect()
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def test_repairs_of_random_conversations(spark):
    rng = random.Random(4)
    rows = {c: random_rows(rng, rng.choice([1, 2, 3, 5, 8, 20])) for c in [None, *range(150)]}
    # A row that stands there n times, and the same row twice in the input.
    flat = [(c, *r, 2 if i % 7 == 3 else 1) for c, own in rows.items() for i, r in enumerate(own)]
    got = reports(spark, flat)
    for c, own in rows.items():
        whole = in_order([r for i, r in enumerate(own) for _ in range(2 if i % 7 == 3 else 1)])
        assert got[c] == expected(whole), (c, whole)


def test_long_conversations_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "partitions_for", lambda *_: 5)
    rng = random.Random(6)
    long = [(i // 3, r, t + f" {i % 700}.") for i, (_, r, t) in enumerate(random_rows(rng, 4_000, ("user", "assistant", "system")))]
    hot = [(None if i % 2 else 7, "user", "Same words.") for i in range(3_000)]
    rows = [(1, *r, 1) for r in long] + [(2, *r, 1) for r in hot] + [(3, 1, "user", "Hi.", 1)]
    got = reports(spark, rows)
    for c, own in ((1, long), (2, hot), (3, [(1, "user", "Hi.")])):
        assert got[c] == expected(in_order(own))
    pieces = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long"))
    assert pieces.where("conv.id = 1").count() > 7


def test_meeting_in_the_middle_is_the_table():
    rng = random.Random(9)
    kind = np.array([rng.randrange(9) for _ in range(400)])
    extra = np.array([rng.choice([0, 0, 2]) for _ in range(400)])
    cost, order = repair.ahead(kind, extra, np.array([0]), np.array([400]), np.array([0]))
    for last in range(4):
        if cost[0, last] < repair._FAR:
            before, behind = repair.solve(kind, extra, np.array([0]), np.array([400]), np.array([0]), np.array([last]))
            assert (before[1:] == behind[:-1]).all() and before[0] == 0 and behind[-1] == last
            assert sum(repair._COST[k, a, b] + 2 * e for k, a, b, e in zip(kind, before, behind, extra)) == cost[0, last]


def test_damage(spark):
    rows = [(c, t, "assistant", f"Say. {c}?!") for c in range(40) for t in range(8)] + [(None, None, None, None), (3, None, "user", None)]
    got = bag(tuple(r) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d:
            want.append((c, t, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text, 2 if d == 3 else 1))
    assert got == bag(want)


def test_repair_of_nothing_and_other_types(spark):
    assert reports(spark, []) == {}
    got = reports(spark, [("x", 1, "user", "A."  , 1), (None, 1, "user", None, 1), ("", None, None, "B.", 1)], "string")
    assert got["x"] == expected([(1, "user", "A.")]) and got[None] == expected([(1, "user", " ")]) and got[""] == expected([(None, " ", "B.")])


# Fill-in-middle


def whole_fim(doc_id, text, rate=100, spm=50, seed=7):
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LINES = ["", "one\n", "\n", "zwei und drei", "é你🙂\n", "<P", ">", "<S>", "S>", "<", "M>\n", "\r\n", " x"]


def fim_rows(rng, n):
    return [(rng.choice([None, rng.randrange(10**12), -rng.randrange(50)]), rng.choice([None, *("".join(rng.choice(LINES) for _ in range(rng.choice([1, 3, 30]))) for _ in range(9))])) for _ in range(n)]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_fim_of_random_texts(spark, rate, spm, monkeypatch):
    rows = fim_rows(random.Random(rate + spm), 300) + PAIRS
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    got = fim.restored(fim.fill_in_middle(df, rate=rate, spm_percent=spm).selectExpr("doc.doc_id", "doc.text", "doc.output AS own", "n", "form", "prefix_chars", "middle_chars", "output"))
    got = got.collect()
    assert bag((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == bag((i, t, *whole_fim(i, t, rate, spm)) for i, t in rows)
    assert all(r["restored"] == (r["text"] or "") and r["own"] == "x" for r in got)
    assert fim.restored(fim.fill_in_middle(df.limit(0))).count() == 0


def test_fim_over_small_batches(monkeypatch):
    """Slabs of any size give the same bytes."""
    import pyarrow as pa

    texts = [t or "" for _, t in fim_rows(random.Random(8), 200)]
    texts = ["" if any(m in t for m in fim.MARKERS) else t for t in texts]
    rng = np.random.default_rng(1)
    h1, h2, spm = rng.integers(0, 99, len(texts)), rng.integers(0, 99, len(texts)), rng.integers(0, 2, len(texts)) > 0
    plain = np.array([not t for t in texts])
    markers = fim.checked(fim.MARKERS)
    data, offsets = fim.buffers(pa.array(texts))
    out, total, *_ = fim.transform(data, offsets, plain, spm & ~plain, h1, h2, markers)
    back, ends = fim.restore(out, total, plain, spm & ~plain, markers)
    assert back.tobytes() == data.tobytes() and ends.tolist() == offsets.tolist()
    for i, t in enumerate(texts):
        one, o = fim.buffers(pa.array([t]))
        alone, size, *_ = fim.transform(one, o, plain[i : i + 1], (spm & ~plain)[i : i + 1], h1[i : i + 1], h2[i : i + 1], markers)
        assert alone.tobytes() == out[total[i] : total[i + 1]].tobytes()


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("aXa", "b", "c"), ("ab", "bc", "x"), ("", "b", "c"), ("abc", "b", "x")])
def test_markers_that_overlap_raise(markers):
    with pytest.raises(ValueError):
        fim.checked(markers)


def test_restore_needs_each_marker_once():
    data = np.frombuffer(b"<P>a<S>b<S><M>", dtype=np.uint8)
    with pytest.raises(ValueError):
        fim.restore(data, np.array([0, len(data)]), np.array([False]), np.array([False]), fim.checked(fim.MARKERS))


def test_choices_are_the_digest(spark):
    row = spark.createDataFrame([(12,)], "doc_id long").select(*fim.hash_parts(7, F.col("doc_id"))).first()
    digest = hashlib.sha256(b"7:12").hexdigest()
    assert list(row) == [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
