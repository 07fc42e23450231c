"""License spans: bounded, in order, of templates of any length."""

from prospark.llm.licenses import LICENSES, NOTICES, Template, license_scan

SCHEMA = "doc_id long, text string"


def labels(spark, texts, **more):
    rows = license_scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), **more).collect()
    return {r["doc_id"]: (r["labels"], round(r["score"], 3)) for r in rows}


def test_scattered_pairs_are_no_notice(spark):
    """Every pair of a notice stands there, but a filler word follows each, or they stand in another order."""
    mit = next(t for t in NOTICES if t.label == "notice-mit").words
    pairs = [f"{a} {b}" for a, b in zip(mit, mit[1:])]
    fillers = " ".join(f"{p} filler{i}" for i, p in enumerate(pairs))
    turned = " ".join(f"{p} x" for p in reversed(pairs))
    far = " ".join(p + " filler" * 30 for p in pairs)
    got = labels(spark, [fillers, turned, far, " ".join(mit), " ".join(mit[:9] + ["really"] + mit[9:])])
    assert got[0] == got[1] == got[2] == ("", 0.0)
    assert got[3] == ("notice-mit", 1.0) and got[4][0] == "notice-mit" and 0.9 < got[4][1] < 1


def test_whole_licenses_with_changes(spark):
    for template in LICENSES:
        words = template.text.split()
        cut = words[:40] + words[40 + len(words) // 12 :]
        texts = [template.text, "Copyright (c) 2020 A. Body\n\n" + template.text + "\nint main() {}", " ".join(cut), " ".join(words[: len(words) // 2]), " ".join(reversed(words))]
        got = labels(spark, texts)
        assert template.label in got[0][0].split(",") and got[0][1] == 1.0 and template.label in got[1][0].split(",")
        assert template.label in got[2][0].split(",")
        assert template.label not in got[3][0].split(",") and template.label not in got[4][0].split(",")


def test_a_template_of_1500_words(spark):
    """A line is left out of a long text, another one is added, and the text is still found, once for each place."""
    words = [f"t{(i * i + 7 * i) % 7919}" for i in range(1500)]
    long = Template("long", " ".join(words))
    changed = words[:600] + words[615:1000] + [f"new{i}" for i in range(20)] + words[1000:]
    got = labels(spark, [" ".join(words), "before " + " ".join(changed) + " after", " ".join(words[:900]), " ".join(words[700:] + words[:700])], base=(), notices=(long,))
    assert got[0] == ("long", 1.0) and got[1][0] == "long" and got[1][1] > 0.95
    assert got[2] == ("", 0.0) and got[3] == ("", 0.0)
