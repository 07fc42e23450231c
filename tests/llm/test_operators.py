"""Operators against brute force on awkward rows, empty tables and extra columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prospark.llm import bpe, contamination, idfiles, langid, licenses, maintext, neardup, passages, quality, warc
from prospark.llm.op09_quality import measures_sql
from prospark.llm.words import WHITE, Words, slabs
from prospark.session import scratch_path
from tests.llm import cases

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.rows(), cases.SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


PAIRS = [(r[0], r[1]) for r in cases.rows()]


def bag(rows):
    return Counter(map(repr, rows))


def test_passages(docs, empty):
    got = passages.without_repeats(docs)
    assert got.schema["doc"].dataType == passages.without_repeats(empty).schema["doc"].dataType
    rows = got.selectExpr("doc.doc_id", "n_words", "n_removed", "kept_text", "doc.part", "removed").collect()
    assert bag(tuple(r)[:4] for r in rows) == bag(cases.passages(PAIRS))
    for r in rows:
        assert sum(b - a + 1 for a, b in zip(r["removed"][::2], r["removed"][1::2])) == r["n_removed"]
    assert passages.without_repeats(empty).count() == 0


def test_passages_in_many_chunks(spark):
    rng = random.Random(3)
    parts = [[f"v{rng.randrange(30)}" for _ in range(40)] for _ in range(12)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(5)) for w in rng.choice(parts)[rng.randrange(20) :])) for i in range(150)]
    got = passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=500)
    assert bag(map(tuple, got.select("doc.doc_id", "n_words", "n_removed", "kept_text").collect())) == bag(cases.passages(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=40), st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20), st.sampled_from([3, 5, 13, 20, 30]))
def test_equal_windows_have_equal_places(middle, left, right, window):
    """Any window of a text has the same keys whatever surrounds it, and at least one."""

    def keys(words):
        data = " ".join(f"x{w}" for w in words).encode()
        own = Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), WHITE, False)
        at, key = passages.place_keys(own, window)
        return dict(zip(at.tolist(), key.tolist()))

    _, reach, longest = passages.parse_depth(window)
    a, b = keys(middle), keys(left + middle + right)
    for s in range(len(middle) - window + 1):
        inner = range(s + reach, s + reach + longest)
        one = {p - s: a[p] for p in inner if p in a}
        assert one and one == {p - s: b[p + len(left)] for p in inner if p + len(left) in b}


def test_near_duplicates(docs, empty):
    for width, percent in ((3, 85), (5, 80)):
        want = cases.near(PAIRS, width, percent)
        for r in neardup.near_duplicates(docs, width, percent).collect():
            assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_in_a_hot_group(spark, width, percent):
    """One text with hundreds of edited copies, some of them edited again: links past the leader must not get lost."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]

    def edit(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
        return words

    family = [edit(base, 9) for _ in range(6)]
    texts = [" ".join(edit(rng.choice(family) if i % 3 else base, rng.randrange(8))) for i in range(260)] + [" ".join(base)] * 9
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs, width, percent).collect()}
    want = cases.near(rows, width, percent)
    assert len(set(want.values())) > 5 and got == want


def test_quality(docs, empty):
    book = quality.ledger(docs)
    rows = book.selectExpr("doc.text AS text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "doc.fail_bits AS own").collect()
    assert len(rows) == len(PAIRS) and {r["own"] for r in rows} == {3}
    for r in rows:
        assert tuple(r)[1:6] == cases.quality(r["text"])
        assert bool(r["fail_bits"] & 1) == (r["n_words"] < 10) and bool(r["fail_bits"] & 2) == (100 * r["n_repeat_words"] > 20 * r["n_words"])
    for version in ("v1", "v2"):
        policy, whole = quality.POLICIES[version], quality.mask(quality.POLICIES[version])
        assert book.where(quality.apply_policy(book, policy)).count() == sum(r["fail_bits"] & whole == 0 for r in rows)
        for r in quality.ablation(book, policy).collect():
            bit = quality.mask([r["rule"]])
            assert r["n_failed"] == sum(bool(x["fail_bits"] & bit) for x in rows) and r["n_only"] == sum(x["fail_bits"] & whole == bit for x in rows)
            assert r["n_kept_without"] == sum(x["fail_bits"] & whole & ~bit == 0 for x in rows)
    assert quality.ledger(empty).count() == 0


def test_quality_leaves_labelled_texts_alone(spark):
    book = quality.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = book.select("doc.doc_id", "fail_bits").join(labels, "doc_id").collect()
    base = quality.mask(quality.POLICIES["base"])
    clean = [r for r in rows if r["quality"] == 1 and not r["fail_bits"] & base]
    assert sum(r["fail_bits"] == 0 for r in clean) >= 0.995 * len(clean)


def test_quality_of_scripts_without_spaces(spark):
    """Clean prose of such scripts is kept from policy v2 on; long words of other scripts beside it are not hidden by it."""
    phrases = {"th": "ประเทศไทยมีแม่น้ำหลายสายที่ไหลผ่านที่ราบ", "zh": "长江是亚洲最长的河流，流经许多省份和城市，最后注入东海。", "ja": "コンピューターの歴史はとても長く、多くの人々が研究してきた。",
               "lo": "ປະເທດລາວມີແມ່ນ້ຳຫຼາຍສາຍທີ່ໄຫຼຜ່ານພູເຂົາ", "km": "ប្រទេសកម្ពុជាមានទន្លេជាច្រើនដែលហូរកាត់", "my": "မြန်မာနိုင်ငံတွင်မြစ်များစွာရှိပြီးတောင်တန်းများ"}
    clean = {k: " ".join(f"{p}{i}" for i in range(12)) for k, p in phrases.items()}
    junk = [" ".join("x" * 25 + str(i) for i in range(12)), " ".join("สั้น" for _ in range(3)) + " " + " ".join(f"คำ {'y' * 30}{i}" for i in range(12))]
    assert all(len(w) > 20 for t in clean.values() for w in t.split())
    rows = spark.createDataFrame([*clean.items(), ("junk", junk[0]), ("mixed", junk[1])], "doc_id string, text string")
    book = quality.ledger(rows)
    got = lambda version: {r["doc_id"] for r in book.where(quality.apply_policy(book, quality.POLICIES[version])).select("doc.doc_id").collect()}
    assert got("v2") == set(clean)
    # The rule of version 1 is on white-space words, as it always was.
    assert not got("v1") & set(clean)


def test_quality_sql_of_scripts_without_spaces(spark):
    """Both word-length rules are those of the SQL, bit by bit."""
    import duckdb

    texts = ["ประเทศไทยมีแม่น้ำหลายสายที่ไหลผ่าน " * 12, "长江是亚洲最长的河流，流经许多省份和城市，最后注入东海。 " * 12, "コンピューターの歴史はとても長く、多く " * 12, "word " * 12, "x" * 300, "", None, "ｆｕｌｌ　ｗｉｄｔｈ " * 9, "日本 " + "y" * 90 + " z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_runs"], r["run_chars"], r["fail_bits"]) for r in quality.ledger(df).select("doc.doc_id", "n_runs", "run_chars", "fail_bits").collect()}
    src = duckdb.from_arrow(df.toArrow())  # noqa: F841
    rows = duckdb.sql(f"WITH s AS (SELECT doc_id AS rid, doc_id, text FROM src),{measures_sql('s')} SELECT doc_id, n_runs, run_chars, CAST(fail_bits AS BIGINT) FROM booked").fetchall()
    assert got == {r[0]: tuple(r[1:]) for r in rows}


def test_licenses(docs, empty):
    for r in licenses.license_scan(docs).collect():
        text = next(t for i, t in PAIRS if i == r["doc_id"])
        w = cases.letters(text)
        places = {x.label: [k for k in range(len(w)) if w[k : k + len(x.words)] == x.words] for x in licenses.BASE}
        flat = [p for ps in places.values() for p in ps]
        assert (r["n_words"], r["n_base"]) == (len(w), len(flat))
        assert (r["first_word"], r["last_word"]) == ((min(flat), max(flat)) if flat else (None, None))
        assert r["base_labels"] == ",".join(sorted(k for k, ps in places.items() if ps)) and 0 <= r["score"] <= 1
        if r["doc_id"] == 19:
            # One word more than the notice: two neighbouring diagonals are one span.
            assert r["labels"] == "gpl,notice-gpl"
    assert licenses.license_scan(empty).count() == 0


@pytest.mark.parametrize("block", [100_000, 3])
def test_contamination(spark, docs, empty, block):
    items = spark.createDataFrame(cases.ITEMS, "item_id long, text string")
    got = contamination.contaminated_words(docs, items, block_windows=block).selectExpr("doc.text AS text", "n_words", "n_hit", "items", "spans").collect()
    assert len(got) == len(PAIRS) and any(r["n_hit"] for r in got)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == cases.contaminated(r["text"], cases.ITEMS)
    assert contamination.contaminated_words(empty, items).count() == 0
    assert contamination.contaminated_words(docs, items.where("item_id = 3")).where("n_hit > 0").count() == 0


def test_bpe(docs, empty):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    rows = bpe.encode_documents(docs, RANKS, P.PATTERN).selectExpr("doc.text AS text", "n_tokens", "ids", "decoded").collect()
    assert len(rows) == len(PAIRS)
    for r in rows:
        want = own.encode_ordinary(r["text"] or "")
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == want and r["n_tokens"] == len(want)
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode_documents(empty, RANKS, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabé's_12²你🙂 .,!\x1c\x85", max_size=40), max_size=5))
def test_bpe_slab(texts):
    global _bpe
    try:
        ranks, own = _bpe
    except NameError:
        ranks = bpe.Ranks(open(RANKS, "rb").read())
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
        _bpe = ranks, own
    ids, sizes = bpe.encode_slab(ranks, bpe.Splitter(P.PATTERN), texts)
    ends = np.cumsum(sizes)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes)] == [own.encode_ordinary(t) for t in texts]


def test_id_files(spark, docs, empty):
    file = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(file)
    for planes in ("byte", "bit"):
        path = scratch_path(spark, "t")
        idfiles.write_ids(docs, path, file, planes=planes, block_ids=1000)
        got = sorted(map(tuple, idfiles.read_checksums(spark, path).collect()), key=lambda r: r[1])
        start, ids = 0, [r[0] for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        for (doc, at, n, crc), text in zip(got, [t for _, t in sorted(PAIRS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]):
            want = tok.encode(text or "", add_special_tokens=False).ids + [0]
            assert (at, n, crc) == (start, len(want), zlib.crc32(np.array(want, dtype="<u4").tobytes()))
            start += n
        pieces = idfiles.read_pieces(spark, path, with_ids=True).where("doc_id = 13").orderBy("block").collect()
        assert len(pieces) > 20 and tok.decode([i for p in pieces for i in p["ids"]][:-1]) == cases.LONG
    path = scratch_path(spark, "t")
    idfiles.write_ids(empty, path, file)
    assert idfiles.read_checksums(spark, path).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", " ", "\u00a0", "\u3000", "\t", "\n", "\r\n", "\x1c", "\u2003", "a", "é", "â", "word", "12", "'s", ".", "你", "　字", "🙂", "<|endoftext|>", "<|", "|>"]), max_size=30).map("".join), max_size=6))
def test_ids_of_pieces_are_those_of_the_library(texts):
    """White space of any kind around single spaces, alone and among the pieces of earlier texts."""
    global _pieces
    try:
        own = _pieces
    except NameError:
        _pieces = own = idfiles.Encoder(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read(), None)
    for batch in (texts, ["a \u00a0 \u00a0 b", "a\u00a0 \u00a0 b c\n", *texts]):
        ids, sizes = own.encode(pa.array(batch, pa.string()))
        ends = np.cumsum(sizes)
        library = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(batch, add_special_tokens=False) if batch is texts and "<" in "".join(batch) else None
        assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes)] == (own.plain(batch) if library is None else [e.ids for e in library])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["bit", "byte"]), st.binary(max_size=50), st.binary(max_size=50))
def test_planes_and_checksums(ids, planes, a, b):
    ids = np.array(ids, dtype=np.uint32)
    width, packed = idfiles.pack(ids, planes)
    assert idfiles.unpack(len(ids), width, packed).tolist() == ids.tolist()
    assert idfiles.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_language(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(5, None, "en"), (6, "12 ...", "en"), (7, "", None), (None, "der und die von der ein nicht ist mit sich auf das den für werden " * 3, "de")], "doc_id long, text string, lang string")
    model = langid.train(table)
    rows = langid.identify(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    got = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in langid.identify(odd, model).collect()}
    assert got[5][0] == got[6][0] == got[7][0] == "und" and got[None] == ("de", False)
    none = langid.train(table.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"} and langid.identify(table.limit(0), none).count() == 0


def test_language_keeps_marks():
    """Vowel signs and other marks belong to their words; a text of marks alone has no letter."""
    assert langid.plain("हिन्दी भाषा में, 12!") == "हिन्दी भाषा में" and langid.plain("ภาษาไทย_é") == "ภาษาไทย é"
    assert langid.plain("e\u0301A") == "e\u0301a" and langid.plain("\u0301 12") == "" and langid.plain("") == ""


def test_archive(spark):
    pages = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (4, "http://c", ""), (None, "http://d", "<p>é</p>"), (9, "http://e", "x" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS header")
    path = scratch_path(spark, "t")
    warc.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    rows = warc.read_archive(spark, path).collect()
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    assert bag((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == bag(
        (i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if top[h or ""] == i else ("revisit", top[h or ""])))
        for i, _, h in pages
    )
    for r in rows:
        head, body = bytes(r["record"])[:-4].split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0]) == len(body)
        assert body == (bytes(r["payload"]) if r["record_type"] == "response" else b"")
    path = scratch_path(spark, "t")
    warc.write_archive(df.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_main_text(spark):
    body = "".join(f"<p>Sentence {k} of the article, with some words in it; and a few more of them.</p>" for k in range(6))
    noise = '<header><a href="/">Site</a></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div><form><label>Mail</label></form>'
    after = '<aside><p>Other things to read.</p></aside><section id="comments"><div class="comment"><p>I do not agree with this at all, sorry to say.</p></div></section><footer>&copy; 2020</footer>'
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body>{noise}<article><h1>Title &amp; more</h1>{body}</article>{after}<script>var x='</p>';</script></body></html>"
    rows = spark.createDataFrame([(1, None, page), (2, "u", None), (None, "u", ""), (3, "u", "<p>un<b>closed <br> te&shy;xt"), (1, None, page)], "page_id long, url string, html string")
    got = sorted(maintext.extract(rows.selectExpr("*", "'x' AS text")).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    want = "Title & more " + " ".join(f"Sentence {k} of the article, with some words in it; and a few more of them." for k in range(6))
    assert got[0]["text"] == want and got[0]["n_chars"] == len(want) and got[1] == got[0]
    assert got[2]["text"] == got[4]["text"] == "" and maintext.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    "source, want",
    [
        ('<p>One <svg class="i"/> two</p><p>three</p>', "One two three"),
        ('<p>One<svg viewBox="0 0 > 9" />two <math/> x</p><p>three <svg><path d="M0"/><title>T</title></svg>four</p>', "Onetwo x three four"),
        ("<p>One <svg-icon></svg-icon> two</p><template-x>three</template-x> <title-bar>four</title-bar><p>five</p>", "One two three four five"),
        ("<p>One</p><object-view>two</object-view><p>three <svg-icon name=a></svg-icon>four</p><svg></svg><p>five</p>", "One two three four five"),
        ("<p>One <canvas> two</p><object data='x'><p>three</p><noscript><p>four", "One two three four"),
        ("<p>One</p><SVG><text>no</text></svg ><template><p>no</p></TEMPLATE><iframe>no</iframe><p>two</p><script>var x='</p>'; <style>", "One two"),
        ("<p>One</p><style>p{}</style x><title>no</titles></title><p>two</p><textarea>no <p>no", "One two"),
    ],
)
def test_icons_and_custom_elements_keep_their_page(source, want):
    assert " ".join(maintext.parse(source).segments) == want


def test_main_text_of_unseen_pages():
    trees, good = maintext.default_trees(), 0
    for source in maintext.example_pages(100, seed=77):
        page = maintext.parse(source)
        label, keep = maintext._labels(page), maintext.decode(page, trees.score(maintext.features(page)))
        good += all(keep[o] == (label[o] == 1) for o in page.owner)
        for i in range(1, len(keep)):
            assert not keep[i] or keep[page.parent[i]]
    assert good >= 95


def test_words_of_slabs():
    texts = [None, "", " a  b\tc ", "x" * 3_000_000, "é ü", "end"]
    got = [w.counts.tolist() for _, w in slabs(pa.array(texts), WHITE, False)]
    assert sum(got, []) == [0, 0, 3, 1, 2, 1]
