"""Substring deduplication by recompression.

Every document is a string of word names. Rounds replace two neighbouring symbols by one: a round gives each symbol a
side by its name, and a left symbol followed by a right one becomes a new symbol named by the pair. Names depend on
content alone, so they are global without an exchange. Symbols inside a run of one symbol have one side and never
pair; the run's inner places then share one key and are listed once per chunk and range.

A symbol after r rounds is fixed by 2**r words, so a place between two symbols after `rounds` rounds is fixed by
`reach` = 2**(rounds-1) words on each side. No symbol grows beyond `window - 2*reach + 1` words; each window of
`window` words therefore has such a place at least `reach` words from both its ends, and equal windows have the same
places. The key of a place names the `2*reach` words around it.

1. Chunks send their distinct keys (32 bits of a key and its range) to key ranges; a range returns to each chunk the
   keys found in two documents or more.
2. Windows whose inner places all have shared keys are candidates. Chunks send 64-bit window names with their
   smallest doc_id to other ranges (the range comes from a second name, so 64 + log2(ranges) bits decide); a range
   returns the smallest doc_id of all for windows that also stand in a larger document.
3. Chunks mark the words of windows that start in a smaller document and join the kept ones.

The three steps read one exchange of the texts. Chunks and ranges are bounded by bytes and their number follows the
input; nothing passes through the driver but the byte count.

Defined cases: a null text has no words; a null doc_id counts as larger than all others, so such a row never makes
others lose words; rows of one doc_id don't count against each other, also when they are repeated; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospark.llm.chunks import CHUNK_BYTES, field, partitions_for, planes, runs, spread, text_bytes, unplanes
from prospark.llm.words import WHITE, Words, mix, pair_names, slabs, window_fits, window_names

NO_ID = np.iinfo(np.int64).max
_BLOCK = "part int, chunk int, names binary, docs binary, several binary"


def parse_depth(window: int) -> tuple[int, int, int]:
    """(rounds, reach, longest symbol) for windows of so many words."""
    if window < 3:
        raise ValueError("a window has 3 words or more")
    rounds = 1
    while window - 2 ** (rounds + 1) + 1 >= 2**rounds:
        rounds += 1
    reach = 2 ** (rounds - 1)
    return rounds, reach, window - 2 * reach + 1


def symbol_starts(words: Words, rounds: int, longest: int) -> np.ndarray:
    """First words of the symbols that are left after all rounds."""
    symbol, start, doc = words.name, np.arange(len(words.name)), words.document()
    size = np.ones(len(symbol), dtype=np.int64)
    for r in range(rounds):
        left = (mix(symbol + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
        joins = left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= longest) & (doc[:-1] == doc[1:])
        at = np.flatnonzero(joins)
        symbol = symbol.copy()
        symbol[at] = pair_names(symbol[at], symbol[at + 1])
        size[at] += size[at + 1]
        stays = np.ones(len(symbol), dtype=bool)
        stays[at + 1] = False
        symbol, start, doc, size = symbol[stays], start[stays], doc[stays], size[stays]
    return start


def place_keys(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys): word positions between two symbols with `reach` words on both sides, and their keys."""
    rounds, reach, longest = parse_depth(window)
    around = window_names(words.name, 2 * reach)
    inside = window_fits(words.first, 2 * reach, len(words.name))
    at = symbol_starts(words, rounds, longest)
    at = at[at >= reach]
    at = at[inside[at - reach]]
    return at, around[at - reach]


def _keys_of_chunk(window: int, ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for row, words in slabs(field(table, "doc", "text"), WHITE, lower=False):
            at, names = place_keys(words, window)
            keys.append(names)
            docs.append(words.document()[at] + row)
        names, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(names, kind="stable")
        names, doc = names[order], doc[order]
        first, size = runs(names)
        several = doc[first] != doc[first + size - 1]
        return _blocks(key[0].as_py(), ranges, spread(names[first], ranges), names[first].astype(np.uint32), None, several)

    return run


def _blocks(chunk: int, ranges: int, part, names, docs, several) -> pa.Table:
    """One row per range that got names; `part` is ascending or gets sorted."""
    if len(part) and np.any(part[1:] < part[:-1]):
        order = np.argsort(part, kind="stable")
        part, names, several = part[order], names[order], None if several is None else several[order]
        docs = None if docs is None else docs[order]
    first, size = runs(part)
    cut = [slice(a, a + n) for a, n in zip(first, size)]
    return pa.table(
        {
            "part": pa.array(part[first].astype(np.int32), type=pa.int32()),
            "chunk": pa.array(np.full(len(first), chunk, dtype=np.int32), type=pa.int32()),
            "names": pa.array([planes(names[c]) for c in cut], type=pa.binary()),
            "docs": pa.array([b"" if docs is None else planes(docs[c]) for c in cut], type=pa.binary()),
            "several": pa.array([b"" if several is None else np.packbits(several[c]).tobytes() for c in cut], type=pa.binary()),
        }
    )


def _gather(table: pa.Table, kind: str):
    """All names of a range in ascending order, with their chunk, smallest document and `several` mark."""
    names = [unplanes(b, kind) for b in table.column("names").to_pylist()]
    sizes = [len(n) for n in names]
    docs = [unplanes(b, "<i8") for b in table.column("docs").to_pylist()]
    several = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for b, n in zip(table.column("several").to_pylist(), sizes)]
    chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
    names, docs, several = (np.concatenate(x) for x in (names, docs, several))
    order = np.argsort(names, kind="stable")
    return names[order], chunk[order], docs[order] if len(docs) else docs, several[order].astype(bool)


def _shared_keys(key: tuple, table: pa.Table) -> pa.Table:
    names, chunk, _, several = _gather(table, "<u4")
    first, size = runs(names)
    both = np.repeat((size > 1) | np.maximum.reduceat(several, first), size)
    return _returned(key[0].as_py(), chunk[both], names[both], None)


def _smallest_docs(key: tuple, table: pa.Table) -> pa.Table:
    names, chunk, docs, several = _gather(table, "<u8")
    first, size = runs(names)
    least = np.repeat(np.minimum.reduceat(docs, first), size)
    back = (docs > least) | several
    return _returned(key[0].as_py(), chunk[back], names[back], least[back])


def _returned(part: int, chunk, names, docs) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    chunk, names, docs = chunk[order], names[order], None if docs is None else docs[order]
    first, size = runs(chunk)
    table = _blocks(0, 0, chunk, names, docs, None)
    return table.set_column(0, "part", pa.array(np.full(len(first), part, dtype=np.int32))).set_column(
        1, "chunk", pa.array(chunk[first].astype(np.int32), type=pa.int32())
    )


def _ids(table: pa.Table) -> np.ndarray:
    return field(table, "doc", "id").cast(pa.int64()).fill_null(NO_ID).to_numpy()


def _windows_of_chunk(window: int, ranges: int):
    _, reach, longest = parse_depth(window)

    def run(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        known = [np.zeros(0, dtype=np.uint64)]
        for part, blob in zip(shared.column("part").to_pylist(), shared.column("names").to_pylist()):
            known.append(unplanes(blob, "<u4").astype(np.uint64) | np.uint64(part << 32))
        known = np.sort(np.concatenate(known))
        names, second, docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        ids = _ids(table)
        if len(known):
            for row, words in slabs(field(table, "doc", "text"), WHITE, lower=False):
                at, keys = place_keys(words, window)
                full = (spread(keys, ranges) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
                lone = np.zeros(len(words.name) + 1, dtype=np.int64)
                lone[at[~_member(known, full)] + 1] = 1
                lone = np.cumsum(lone)
                fits = window_fits(words.first, window, len(words.name))
                s = np.flatnonzero(fits[: max(0, len(words.name) - window + 1)])
                s = s[lone[s + reach + longest] == lone[s + reach]]
                if len(s):
                    names.append(window_names(words.name, window)[s])
                    second.append(window_names(words.name ^ np.uint64(0x5851F42D4C957F2D), window)[s])
                    docs.append(ids[row + words.document()[s]])
        names, second, docs = np.concatenate(names), np.concatenate(second), np.concatenate(docs)
        part = spread(second, ranges)
        order = np.lexsort((docs, names, part))
        part, names, docs = part[order], names[order], docs[order]
        new = np.ones(len(names), dtype=bool)
        new[1:] = (names[1:] != names[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(names))[: len(first)] - 1
        return _blocks(key[0].as_py(), ranges, part[first], names[first], docs[first], docs[first] != docs[last])

    return run


def _member(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), dtype=bool)


def _marked(window: int):
    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        names = np.concatenate([np.zeros(0, dtype=np.uint64), *[unplanes(b, "<u8") for b in found.column("names").to_pylist()]])
        least = np.concatenate([np.zeros(0, dtype=np.int64), *[unplanes(b, "<i8") for b in found.column("docs").to_pylist()]])
        order = np.argsort(names, kind="stable")
        names, least = names[order], least[order]
        quick = np.zeros(1 << 22, dtype=bool)
        quick[names & np.uint64(len(quick) - 1)] = True
        ids = _ids(table)
        counts, removed, texts, spans = [], [], [], []
        for row, words in slabs(field(table, "doc", "text"), WHITE, lower=False):
            total = len(words.name)
            gone = np.zeros(total + 1, dtype=np.int64)
            if len(names) and total >= window:
                own = window_names(words.name, window)
                s = np.flatnonzero(window_fits(words.first, window, total)[: len(own)] & quick[own & np.uint64(len(quick) - 1)])
                s = s[_member(names, own[s])]
                s = s[least[np.searchsorted(names, own[s])] < ids[row + words.document()[s]]]
                np.add.at(gone, s, 1)
                np.add.at(gone, s + window, -1)
            gone = np.cumsum(gone[:total]) > 0
            before = np.concatenate(([0], np.cumsum(gone)))
            counts.append(words.counts)
            removed.append(np.diff(before[words.first]))
            texts += kept_texts(words, ~gone)
            spans += removed_spans(words, gone)
        return pa.table(
            {
                "doc": field(table, "doc", "row"),
                "n_words": pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *counts]), type=pa.int64()),
                "n_removed": pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *removed]), type=pa.int64()),
                "removed": pa.array(spans, type=pa.list_(pa.int64())),
                "kept_text": pa.array(texts, type=pa.string()),
            }
        )

    return run


def kept_texts(words: Words, kept: np.ndarray) -> list[str]:
    """The kept words of each document, one space between two."""
    data, n = words.data.copy(), len(words.data)
    edge = np.zeros(n + 2, dtype=np.int8)
    edge[words.start[kept]] += 1
    edge[words.end[kept]] -= 1
    stays = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    at, doc = np.flatnonzero(kept), words.document()[kept]
    gap = words.end[at[:-1][doc[:-1] == doc[1:]]]
    stays[gap] = True
    data[gap] = 0x20
    out = data[stays].tobytes()
    to = np.concatenate(([0], np.cumsum(stays)))[words.offsets]
    return [out[a:b].decode() for a, b in zip(to[:-1], to[1:])]


def removed_spans(words: Words, gone: np.ndarray) -> list[list[int]]:
    """First and last removed word of each span, one after another, for each document."""
    out: list[list[int]] = [[] for _ in range(words.docs)]
    if gone.any():
        doc = words.document()
        same = (doc[1:] == doc[:-1]) & gone[1:] & gone[:-1]
        begin, end = gone.copy(), gone.copy()
        begin[1:] &= ~same
        end[:-1] &= ~same
        for d, a, b in zip(doc[begin], np.flatnonzero(begin), np.flatnonzero(end)):
            out[d] += [int(a - words.first[d]), int(b - words.first[d])]
    return out


def without_repeats(docs: DataFrame, window: int = 13, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents without words of windows that also start in a document of smaller doc_id.

    Returns one row per row of `docs`: `doc` (a struct of all its columns), n_words, n_removed, `removed` (first and
    last word of each removed span, flat) and kept_text.
    """
    parse_depth(window)
    n = partitions_for(docs, text_bytes(docs), chunk_bytes)
    rows = docs.select(
        F.struct(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("doc"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(4 * n)).cast("int").alias("chunk"),
    ).repartition(n, "chunk")
    by_chunk = rows.groupBy("chunk")
    keys = by_chunk.applyInArrow(_keys_of_chunk(window, n), _BLOCK)
    shared = keys.groupBy("part").applyInArrow(_shared_keys, _BLOCK)
    windows = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_windows_of_chunk(window, n), _BLOCK)
    found = windows.groupBy("part").applyInArrow(_smallest_docs, _BLOCK)
    result = T.StructType([T.StructField("doc", rows.schema["doc"].dataType["row"].dataType, False)])
    for name, kind in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("removed", T.ArrayType(T.LongType())), ("kept_text", T.StringType())):
        result.add(name, kind)
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(_marked(window), result)
