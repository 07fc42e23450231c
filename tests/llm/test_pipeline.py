"""The pipeline's stages against brute force, one after another."""

import base64

import numpy as np
import public_tokenizers as P
import regex
import tiktoken

import corpus_pipeline
from prospark.llm import quality
from tests.llm import cases


UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\u3000-\u303F\u30A0-\u30FF\uFF00-\uFFEF]+")


def brute(rows, items):
    """(doc_id, text) of the rows that each stage leaves."""
    out = []
    limit = {r.name: r for r in quality.RULES}
    assert set(quality.POLICIES[quality.CURRENT]) <= set(limit)

    def fails(text):
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = cases.quality(text)
        n_upper = sum(c.isupper() for c in text or "")
        n_lines = sum(bool(cases.white(x)) for x in (text or "").split("\n"))
        runs = cases.white(UNSPACED.sub(" ", text or ""))
        n_runs, run_chars = len(runs), sum(map(len, runs))
        values = {k: v for k, v in locals().items() if k.startswith("n_") or k in ("word_chars", "run_chars")}
        return any(eval(limit[name].fails, {}, values) for name in quality.POLICIES[quality.CURRENT])  # noqa: S307

    rows = [(i, t) for i, t in rows if not fails(t)]
    out.append(rows)
    top = cases.near(rows, 5, 80)
    rows = [(i, t) for i, t in rows if i is None or top[i] == i]
    out.append(rows)
    rows = [(i, kept if gone else t) for (i, t), (_, _, gone, kept) in zip(rows, cases.passages(rows))]
    out.append(rows)
    out.append([(i, t) for i, t in rows if not cases.contaminated(t, items)[1]])
    return out


def check(spark, docs, sf_dir, items):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(rows, items)):
        columns = docs.columns
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
    own = tiktoken.Encoding("o", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(repr((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in last) == sorted(repr((i, own.encode_ordinary(t or ""))) for i, t in want)
    return last


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    last = check(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, items)
    assert len(last) == corpus_pipeline.run(spark, sf).count()


def test_awkward_documents(spark):
    sf = "/root/testdata/sf0.001"
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.createDataFrame(cases.rows(), cases.SCHEMA)
    check(spark, docs, sf, items)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
