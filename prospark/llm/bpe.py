"""Byte-level BPE by corpus-level merge replay.

A task takes the distinct words (matches of the split pattern) of its share of the corpus, one slab of texts after
another, lays their bytes out as one string of symbols and replays the merges of the vocabulary over all of them at
once: an inverted index holds, for each rank, the places of the pairs that merge to it. Ranks are taken in order; a
merge touches its places and their two neighbours, whose new pairs enter the index. Each distinct word is encoded once
a slab, however often it stands there. A word's ids depend on nothing but the word, so slabs need no exchange: the
corpus is cut, not the result.

The vocabulary (50 256 ranks here) is a parameter of bounded size and is broadcast.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded one by one; other
columns come back in the struct `doc` as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospark.llm.chunks import field, packed, runs

SLAB_CHARS = 8_000_000
MOST_RANKS = 1_000_000
_NONE = np.iinfo(np.int32).max
#: White space as Unicode defines it; Python's own classes add four ASCII controls.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Ranks:
    """Tokens by rank, and the rank that each pair of tokens merges to."""

    def __init__(self, lines: bytes):
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        if len(rank) > MOST_RANKS:
            raise ValueError(f"{len(rank)} ranks; a task holds at most {MOST_RANKS}")
        self.rank = rank
        self.tokens = [b""] * (max(rank.values()) + 1)
        for token, r in rank.items():
            self.tokens[r] = token
        self.byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, r in rank.items():
            for i in range(1, len(token)):
                a, b = rank.get(token[:i]), rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)


class Replay:
    """All merges over many words at once."""

    def __init__(self, ranks: Ranks, words: list[bytes]):
        self.ranks = ranks
        size = np.array([len(w) for w in words], dtype=np.int64)
        self.ends = np.cumsum(size)
        n = int(self.ends[-1]) if len(words) else 0
        self.symbol = ranks.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        self.next = np.arange(1, n + 1)
        self.before = np.arange(-1, n - 1)
        self.next[self.ends[size > 0] - 1] = -1
        self.before[(self.ends - size)[size > 0]] = -1
        self.alive = np.ones(n, dtype=bool)
        #: The rank that the pair beginning at each place merges to.
        self.rank = np.full(n, _NONE, dtype=np.int32)
        at = np.flatnonzero(self.next >= 0)
        self.index: dict[int, list[np.ndarray]] = {}
        self.queue: list[int] = []
        self._enter(at)

    def _enter(self, at: np.ndarray) -> None:
        """Looks up the pairs that begin at these places and puts them into the index."""
        rank = np.full(len(at), _NONE, dtype=np.int32)
        has = np.flatnonzero(self.next[at] >= 0)
        rank[has] = self.ranks.of_pairs(self.symbol[at[has]], self.symbol[self.next[at[has]]])
        self.rank[at] = rank
        has = np.flatnonzero(rank != _NONE)
        if len(has) > 1:
            has = has[np.argsort(rank[has], kind="stable")]
        rank, at = rank[has], at[has]
        first, many = runs(rank)
        for a, n in zip(first.tolist(), many.tolist()):
            r = int(rank[a])
            if r in self.index:
                self.index[r].append(at[a : a + n])
            else:
                self.index[r] = [at[a : a + n]]
                heapq.heappush(self.queue, r)

    def _merge(self, r: int) -> None:
        at = self.index.pop(r)
        at = np.unique(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
        at = at[(self.rank[at] == r) & self.alive[at]]
        if not len(at):
            return
        second = self.next[at]
        if len(at) > 1 and np.any(second[:-1] == at[1:]):
            # Pairs that overlap: the left one goes first.
            taken, end = [], -1
            for k, (a, b) in enumerate(zip(at.tolist(), second.tolist())):
                if a != end:
                    taken.append(k)
                    end = b
            at, second = at[taken], second[taken]
        after, before = self.next[second], self.before[at]
        self.symbol[at] = r
        self.alive[second] = False
        self.next[at] = after
        some = after >= 0
        self.before[after[some]] = at[some]
        touched = np.concatenate([at, before[before >= 0]])
        # A merged place can be the neighbour of another one.
        self._enter(np.unique(touched) if len(at) > 1 else touched[self.alive[touched]])

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids of each word)."""
        while self.queue:
            self._merge(heapq.heappop(self.queue))
        count = np.concatenate(([0], np.cumsum(self.alive)))
        return self.symbol[self.alive], np.diff(np.concatenate(([0], count[self.ends])))


class Splitter:
    """Matches of the split pattern. Texts of ASCII and Latin letters alone take an equal pattern of a faster engine."""

    def __init__(self, pattern: str):
        self.whole = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        fast = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.fast = re.compile(fast) if r"\p" not in fast else None
        self.other = re.compile(r"[^\x00-\x1b\x20-\x7e\u00c0-\u024f]")

    def __call__(self, text: str) -> list[str]:
        return (self.whole if self.fast is None or self.other.search(text) else self.fast).findall(text)


def encode_slab(ranks: Ranks, split: Splitter, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, ids of each text)."""
    number: dict[str, int] = {}
    units, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = split(text)
        for w in words:
            if w not in number:
                number[w] = len(number)
        units.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
        sizes[i] = len(words)
    raw = [w.encode() for w in number]
    # A word that is a token is that token, whatever its merges.
    token = np.array([ranks.rank.get(w, -1) for w in raw], dtype=np.int64)
    rest = np.flatnonzero(token < 0)
    ids, each = Replay(ranks, [raw[i] for i in rest]).run()
    count = np.ones(len(raw), dtype=np.int64)
    count[rest] = each
    at = np.cumsum(count) - count
    flat = np.empty(int(count.sum()), dtype=np.uint32)
    whole = np.flatnonzero(token >= 0)
    flat[at[whole]] = token[whole]
    flat[np.repeat(at[rest] - (np.cumsum(each) - each), each) + np.arange(len(ids))] = ids
    out, per_text = [], np.zeros(len(texts), dtype=np.int64)
    for i, unit in enumerate(units):
        n = count[unit]
        to = np.cumsum(n)
        per_text[i] = to[-1] if len(to) else 0
        out.append(flat[np.repeat(at[unit] - (to - n), n) + np.arange(per_text[i])])
    return (np.concatenate(out) if out else flat[:0]), per_text


def decode(ranks: Ranks, ids: np.ndarray) -> bytes:
    return b"".join(map(ranks.tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`doc` (all columns), n_tokens, `ids` (binary: little-endian unsigned 32-bit ids) and `decoded` (their bytes)."""
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(Ranks(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, split = shared.value, Splitter(pattern)
        for batch in batches:
            column = field(pa.Table.from_batches([batch]), "doc", text_col)
            size = pa.compute.fill_null(pa.compute.utf8_length(column), 0).to_numpy()
            slab = np.cumsum(size) // SLAB_CHARS
            for s in np.unique(slab):
                rows = np.flatnonzero(slab == s)
                first, n = int(rows[0]), len(rows)
                ids, per_text = encode_slab(ranks, split, [t or "" for t in column.slice(first, n).to_pylist()])
                ends = np.cumsum(per_text)
                cut = [ids[a:b] for a, b in zip(ends - per_text, ends)]
                # Ids leave in small batches: their bytes are many times a slab's distinct words.
                for at in range(0, n, 500):
                    part = cut[at : at + 500]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first + at, len(part)),
                            pa.array(per_text[at : at + 500]),
                            pa.array([p.astype("<u4").tobytes() for p in part], pa.binary()),
                            pa.array([decode(ranks, p) for p in part], pa.binary()),
                        ],
                        ["doc", "n_tokens", "ids", "decoded"],
                    )
                # A worker lives on: what a slab held must not stay with it.
                del ids, cut
                pa.default_memory_pool().release_unused()

    rows = packed(docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType, False)])
    for name, kind in (("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.BinaryType())):
        schema.add(name, kind)
    return rows.mapInArrow(run, schema)
