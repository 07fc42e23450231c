"""Words that polynomial names confuse, very many repeated rows, and windows that very many items share."""

import random

import numpy as np
import pyarrow as pa

from prospark.llm import contamination, neardup, passages
from prospark.llm.words import PUNCT, WHITE, slabs, word_names
from tests.llm import cases
from tests.llm.test_operators import bag

#: A Thue-Morse word and its complement have one value under any polynomial modulo a power of two.
ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
OTHER = ONE.translate({97: 98, 98: 97})
FILL = [f"w{i}" for i in range(40)]


def test_names_of_words():
    rng = random.Random(2)
    made = {ONE, OTHER, ONE[:128], OTHER[:128], *("".join(rng.choice("ab\0é") for _ in range(rng.choice([1, 7, 8, 9, 16, 31, 64, 255, 256, 257, 300]))) for _ in range(4000))}
    texts = sorted(made)
    names = {}
    for column in (pa.array(texts), pa.array([" ".join(texts)]), pa.array(["x " + " ".join(texts[::-1])])):
        for _, words in slabs(column, WHITE, False):
            raw = words.data.tobytes()
            for a, b, n in zip(words.start.tolist(), words.end.tolist(), words.name.tolist()):
                assert names.setdefault(raw[a:b], n) == n
    assert len(set(names.values())) == len(names) >= len(texts)
    lower = [w.name.tolist() for t in ("ÀB" * 9 + "CDé", "Àb" * 9 + "cdé") for _, w in slabs(pa.array([t]), PUNCT, True)]
    assert lower[0] == lower[1] and len(word_names(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


def test_passages_tell_words_apart(spark):
    rows = [(1, " ".join([*FILL[:12], ONE, *FILL[20:30]])), (2, " ".join([*FILL[:12], OTHER, *FILL[20:30]])), (3, " ".join([*FILL[:12], ONE]))]
    got = passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert bag(map(tuple, got.select("doc.doc_id", "n_words", "n_removed", "kept_text").collect())) == bag(cases.passages(rows))


def test_near_duplicates_tell_words_apart(spark):
    rows = [(1, f"x {ONE} y"), (2, f"x {OTHER} y"), (3, f"x {ONE} y")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 1}


def test_contamination_tells_words_apart(spark):
    docs = spark.createDataFrame([(1, " ".join([*FILL[:9], ONE])), (2, " ".join([*FILL[:9], OTHER]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join([*FILL[:9], OTHER]))], "item_id long, text string")
    got = contamination.contaminated_words(docs, items).select("doc.doc_id", "n_hit", "items").collect()
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in got} == {1: (0, []), 2: (10, ["7"])}


def test_near_duplicates_of_very_many_repeated_rows(spark):
    """Thousands of rows of one id and of its near copy, and a third of all rows of one text."""
    base = [f"t{i}" for i in range(60)]
    near = [*base[:59], "end"]
    rows = [(5, " ".join(base))] * 3000 + [(6, " ".join(near))] * 3000 + [(100 + i, "copies of one text stand here") for i in range(4000)]
    rows += [(9000 + i, " ".join(f"u{i}x{k}" for k in range(9))) for i in range(500)] + [(None, " ".join(base)), (5, "another text of the same id is here")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert by[5] == {(5, True)} and by[6] == {(5, False)} and by[None] == {(None, True)}
    assert all(by[100 + i] == {(100, i == 0)} for i in range(4000)) and all(by[9000 + i] == {(9000 + i, True)} for i in range(500))


def test_a_leader_of_many_classes(spark):
    """More classes with one leader than salts."""
    base = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join([*base, *([f"v{i}"] if i else [])])) for i in range(3 * neardup.SALTS)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_a_window_that_very_many_items_share(spark):
    """Ten thousand items begin alike; blocks stay small and every item is found."""
    line = " ".join(FILL[:10])
    items = spark.createDataFrame([(i, f"{line} only{i}") for i in range(10_000)] + [(None, line)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {line} it is"), (2, f"{line} only77 twice {line}"), (3, "nothing of it")], "doc_id long, text string")
    got = contamination.contaminated_words(docs, items, block_windows=6000).select("doc.doc_id", "n_words", "n_hit", "items", "spans").collect()
    by = {r["doc_id"]: r for r in got}
    ids = sorted(str(i) for i in range(10_000))
    assert (by[1]["n_hit"], by[1]["items"], by[1]["spans"]) == (10, ids, [1, 11])
    assert (by[2]["n_hit"], by[2]["items"], by[2]["spans"]) == (21, ids, [0, 11, 12, 22]) and by[3]["n_hit"] == 0
