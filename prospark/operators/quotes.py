"""Quotes looked up in a whole corpus.

Quotes are a stated set of patterns that is held against every page, a bounded block of it at a time. Inside a quote of
three words or more some words must be whole words of the page: a run of at most three of them, the longest of the
quote, is its key, and a page passes on only keys that stand in the block. Quotes of one or two words, and quotes of
marks alone, may begin and end inside a word; an automaton over all of them (Aho-Corasick) reads each page once. So
nothing of a page becomes a row unless a quote has it, and only pages that hold a key are compared with its quotes.

A block has at most `KEYS_PER_PASS` keys (8 bytes each) and about `SHORT_BYTES` of short quotes; both are counted
before they are sent. More quotes take more passes over the searchable text, which is then stored first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospark.functions.spans import Runs, among, batches_of
from prospark.functions.text import quote_parts
from prospark.session import cut_lineage

KEYS_PER_PASS = 4_000_000
SHORT_BYTES = 1 << 20
#: Kinds of quotes: a run of whole words inside, pieces of words, marks alone, nothing to look for.
RUN, PIECE, MARKS, ANY = "run", "piece", "marks", "any"
MOST_WORDS = 3


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of each quote of three words or more: its longest inner run of at most MOST_WORDS words."""
    for batch in batches:
        runs = Runs(batch.column(1))
        begin = np.searchsorted(runs.row, np.arange(batch.num_rows))
        words = np.searchsorted(runs.row, np.arange(batch.num_rows), side="right") - begin
        sizes = np.minimum(words - 2, MOST_WORDS)
        first = begin + 1
        best, length = first.copy(), np.zeros(len(first), dtype=np.int64)
        for row in range(batch.num_rows):
            a = np.arange(first[row], begin[row] + words[row] - sizes[row])
            best[row] = a[np.argmax(runs.end[a + sizes[row] - 1] - runs.start[a])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs.names(best, best + sizes - 1)), pa.array(sizes.astype(np.int32))], ["quote_id", "key", "size"])


def _found(keys, sizes: list[int], short):
    """Keys and short quotes of each page that has any, with the page's words if a key is among them."""

    def automaton(texts: list[str]):
        import ahocorasick

        made = ahocorasick.Automaton()
        for t in texts:
            made.add_word(t, t)
        made.make_automaton()
        return made if texts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(keys.value, dtype=np.int64)
        search = {name: automaton(texts) for name, texts in short.value.items()}
        for batch in batches:
            words = batch.column(1)
            for a, b in batches_of(words):
                found: dict[int, set[int]] = {}
                runs = Runs(words.slice(a, b - a)) if sizes else None
                for n in sizes:
                    row, name = runs.of_size(n)
                    hit = np.flatnonzero(among(name, wanted))
                    for r, k in zip(row[hit].tolist(), name[hit].tolist()):
                        found.setdefault(r, set()).add(k)
                pieces = [
                    [{t for _, t in search[kind].iter(text)} if search[kind] and text else set() for text in batch.column(at).slice(a, b - a).to_pylist()]
                    for kind, at in ((PIECE, 1), (MARKS, 2))
                ]
                rows = [r for r in range(b - a) if r in found or pieces[0][r] or pieces[1][r]]
                if rows:
                    own = words.slice(a, b - a).take(pa.array(rows))
                    mask = pa.array([r in found for r in rows])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a, b - a).take(pa.array(rows)),
                            pa.compute.if_else(mask, own, pa.scalar(None, own.type)),
                            pa.array([sorted(found.get(r, ())) for r in rows], pa.list_(pa.int64())),
                            *[pa.array([sorted(p[r]) for r in rows], pa.list_(pa.string())) for p in pieces],
                        ],
                        ["page_id", "words", "keys", PIECE, MARKS],
                    )

    return run


def quotes_in_corpus(quotes: DataFrame, pages: DataFrame, keys_per_pass: int = KEYS_PER_PASS, short_bytes: int = SHORT_BYTES) -> DataFrame:
    """(quote_id, page_id) for every quote (quote_id, evidence) that stands in the words or marks of a page.

    `pages` has page_id, words and marks in the searchable form. A quote without any text is on no page, one of which
    nothing is left to look for on every page; repeated quotes and pages are found once each.
    """
    spark = quotes.sparkSession
    given = quotes.select("quote_id", quote_parts(F.col("evidence")).alias("q")).filter("q.given").select("quote_id", "q.words", "q.bare").distinct()
    count = F.size(F.split("words", " "))
    kind = F.when(F.col("bare") == "", ANY).when(F.col("words") == "", MARKS).when(count < 3, PIECE).otherwise(RUN)
    given = cut_lineage(given.withColumn("kind", kind))
    long = given.where(F.col("kind") == RUN).select("quote_id", "words")
    keyed = cut_lineage(long.mapInArrow(_keyed, f"quote_id {given.schema['quote_id'].dataType.simpleString()}, key long, size int"))
    text = F.when(F.col("kind") == PIECE, F.col("words")).otherwise(F.col("bare"))
    short = given.where(F.col("kind").isin(PIECE, MARKS)).select("quote_id", "kind", text.alias("text"))
    distinct = short.select("kind", "text").distinct()
    n_keys, sizes = keyed.agg(F.count_distinct("key"), F.sort_array(F.collect_set("size"))).first()
    n_bytes, n_any = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0, given.where(F.col("kind") == ANY).count()
    passes = max(1, -(-n_keys // keys_per_pass), -(-n_bytes // short_bytes))
    texts = pages.select("page_id", "words", "marks")
    texts = cut_lineage(texts) if passes > 1 else texts
    block = lambda df, c: df.where(F.pmod(F.xxhash64(c), F.lit(passes)) == i) if passes > 1 else df
    found = None
    for i in range(passes if n_keys or n_bytes else 0):
        own = block(keyed.select("key").distinct(), "key").toArrow().column(0).to_numpy()
        some = block(distinct, "text").collect()
        sent = {k: [r["text"] for r in some if r["kind"] == k] for k in (PIECE, MARKS)}
        run = _found(spark.sparkContext.broadcast(np.sort(own).tobytes()), sizes, spark.sparkContext.broadcast(sent))
        id_type = pages.schema["page_id"].dataType.simpleString()
        part = texts.mapInArrow(run, f"page_id {id_type}, words string, keys array<long>, {PIECE} array<string>, {MARKS} array<string>")
        found = part if found is None else found.unionByName(part)
    answers = []
    if found is not None:
        found = cut_lineage(found)
        pairs = found.select("page_id", F.explode("keys").alias("key")).join(keyed, "key").select("page_id", "quote_id").distinct()
        whole = pairs.join(long, "quote_id").withColumnRenamed("words", "quoted").join(found.where("words IS NOT NULL").select("page_id", "words"), "page_id")
        answers.append(whole.where(F.contains("words", F.col("quoted"))).select("quote_id", "page_id"))
        for name in (PIECE, MARKS):
            own = found.select("page_id", F.explode(name).alias("text"))
            answers.append(own.join(short.where(F.col("kind") == name), "text").select("quote_id", "page_id"))
    if n_any:
        every = texts.select("page_id", F.lit(ANY).alias("kind"))
        answers.append(every.join(given.where(F.col("kind") == ANY), "kind").select("quote_id", "page_id"))
    if not answers:
        return given.select("quote_id").join(pages.select("page_id").limit(0), F.lit(False))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out.distinct()
