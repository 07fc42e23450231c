"""Benchmark decontamination by a prefix-filtered join of item windows to documents.

An item's windows are its runs of `window` words (an item of fewer words is one window). The words of all windows are
ordered by rarity, counted over all documents. A window must be contained whole, so its prefix is its rarest word
alone: each place of that word in a document is joined to the windows it is the prefix of, the place and the lengths
of document and window bound where the window could stand, and the names of all its words decide.

Windows are handled in blocks of about `block_windows` rows of (window, item), dealt by a hash of both: a window that
very many items share is spread over blocks as well, so what the driver sends and a task holds has a fixed bound at
every size of the benchmark. In a block each distinct window stands once, with its items. Each further block is one
more pass over the documents, whose state is written to the shared folder in between. Documents are never exchanged.

Defined cases: a null or empty text has no words and is clean; an item without words has no windows; an item with a
null id marks words but is not counted; repeated item ids count once; repeated documents are judged one by one; an
empty benchmark leaves all documents clean. All columns of the documents come back in the struct `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospark.llm.chunks import field, packed, runs
from prospark.llm.words import PUNCT, slabs, window_names
from prospark.session import cut_lineage

BLOCK_WINDOWS = 200_000


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(item, names): one row for each distinct window of each item; names are the windows' word names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, words in slabs(batch.column(1), PUNCT, lower=True):
                for d in range(words.docs):
                    own = words.name[words.first[d] : words.first[d + 1]].view(np.int64)
                    if len(own):
                        width = min(window, len(own))
                        views = np.lib.stride_tricks.sliding_window_view(own, width)
                        for at in range(0, len(views), 10_000):
                            part = views[at : at + 10_000]
                            names = pa.ListArray.from_arrays(np.arange(0, part.size + 1, width, dtype=np.int32), pa.array(part.reshape(-1)))
                            yield pa.RecordBatch.from_arrays([pa.array([ids[row + d].as_py()] * len(part), pa.string()), names], ["item", "names"])

    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item string, names array<long>").distinct()


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each name of the vocabulary stands in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(np.sort(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = known.value
        total = np.zeros(len(names), dtype=np.int64)
        find = Finder(names)
        for batch in batches:
            for _, words in slabs(batch.column(0), PUNCT, lower=True):
                total += np.bincount(find(words.name)[1], minlength=len(names))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[seen].view(np.int64)), pa.array(total[seen])], ["name", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return {r["name"]: r["n"] for r in counts.collect()}  # at most the vocabulary of one block


class Finder:
    """Places of known names in an array of names."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[names & np.uint64(len(self.bits) - 1)] = True

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in values, places in the known names)."""
        at = np.flatnonzero(self.bits[values & np.uint64(len(self.bits) - 1)])
        if not len(self.names) or not len(at):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        to = np.minimum(np.searchsorted(self.names, values[at]), len(self.names) - 1)
        same = self.names[to] == values[at]
        return at[same], to[same]


class Block:
    """Windows of one block, found by their rarest word."""

    def __init__(self, rows: list[tuple[str | None, list[int]]], counts: dict[int, int]):
        # A window with a word that no document has cannot stand anywhere.
        items: dict[tuple[int, ...], list[str]] = {}
        for item, names in rows:
            if all(n in counts for n in names):
                own = items.setdefault(tuple(names), [])
                if item is not None:
                    own.append(item)
        windows, self.items = list(items), list(items.values())
        self.size = np.array([len(w) for w in windows], dtype=np.int64)
        self.words = [np.array(w, dtype=np.int64).view(np.uint64) for w in windows]
        self.offset = np.array([min(range(len(w)), key=lambda i: (counts[w[i]], w[i], i)) for w in windows], dtype=np.int64)
        prefix = np.array([w[o] for w, o in zip(self.words, self.offset)], dtype=np.uint64)
        self.name = np.array([window_names(w, len(w))[0] for w in self.words], dtype=np.uint64)
        self.order = np.argsort(prefix, kind="stable")
        first, self.many = runs(prefix[self.order])
        self.first = first
        self.find = Finder(prefix[self.order][first])

    def places(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(first words, windows) of all windows standing in the documents of a slab."""
        at, prefix = self.find(words.name)
        starts, windows = [], []
        # Places are joined a part at a time: a common prefix word meets many windows.
        for part in np.array_split(np.arange(len(at)), max(1, -(-int(self.many[prefix].sum()) // 1_000_000))):
            many = self.many[prefix[part]]
            own = np.repeat(at[part], many)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            window = self.order[np.repeat(self.first[prefix[part]], many) + nth]
            start = own - self.offset[window]
            doc = np.searchsorted(words.first, own, side="right") - 1
            fits = (start >= words.first[doc]) & (start + self.size[window] <= words.first[doc + 1])
            starts.append(start[fits])
            windows.append(window[fits])
        start, window = np.concatenate(starts), np.concatenate(windows)
        found = np.zeros(len(start), dtype=bool)
        for size in np.unique(self.size[window]):
            of = np.flatnonzero(self.size[window] == size)
            found[of] = window_names(words.name, int(size))[start[of]] == self.name[window[of]]
        for i in np.flatnonzero(found):
            found[i] = np.array_equal(words.name[start[i] : start[i] + self.size[window[i]]], self.words[window[i]])
        return start[found], window[found]


_STATE = [
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
]


def _match(block, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            spans = [np.array(s or [], dtype=np.int64).reshape(-1, 2) for s in batch.column(1).to_pylist()]
            items = [set(x or []) for x in batch.column(2).to_pylist()]
            n_words, n_hit = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            for row, words in slabs(field(table, "doc", text_col), PUNCT, lower=True):
                start, window = block.value.places(words)
                doc = np.searchsorted(words.first, start, side="right") - 1
                for d in np.unique(doc):
                    of = doc == d
                    first = start[of] - words.first[d]
                    spans[row + d] = merged(np.concatenate([spans[row + d], np.stack([first, first + block.value.size[window[of]]], axis=1)]))
                    items[row + d].update(*(block.value.items[w] for w in np.unique(window[of])))
                n_words[row : row + words.docs] = words.counts
            for d, s in enumerate(spans):
                n_hit[d] = (s[:, 1] - s[:, 0]).sum()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s.reshape(-1).tolist() for s in spans], pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array(n_words),
                    pa.array(n_hit),
                ],
                ["doc", "spans", "items", "n_words", "n_hit"],
            )

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching (first, end) spans as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """`doc`, n_words, n_hit, `items` (ids of items with a window in the text, sorted) and `spans` (first and end word
    of each hit span, flat)."""
    spark = docs.sparkSession
    windows = cut_lineage(item_windows(items, window))
    blocks = max(1, -(-windows.count() // block_windows))
    docs = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    rows = packed(docs, F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        own = [(r["item"], r["names"]) for r in windows.where(F.pmod(F.xxhash64("names", "item"), F.lit(blocks)) == b).collect()]
        vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[np.array(n, dtype=np.int64) for _, n in own]]).view(np.uint64))
        block = spark.sparkContext.broadcast(Block(own, word_counts(docs, vocabulary)))
        schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType, False), *_STATE])
        rows = rows.select("doc", "spans", "items").mapInArrow(_match(block, text_col), schema)
        if b + 1 < blocks:
            rows = cut_lineage(rows)
    return rows.select("doc", "n_words", "n_hit", "items", "spans")
