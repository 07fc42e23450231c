"""Token counts under a sentencepiece BPE model by rank-synchronous array merging.

Normalized texts are cut into pre-tokens between any two characters that stand side by side in no token of the
vocabulary: no merge can cross such a place. Distinct pre-tokens of a batch lie one after another in ragged numpy
arrays; each round finds the lowest rank of every sequence and merges that pair in all sequences at once, until no pair
has a token. The symbols that survive are the tokens; a character without a token counts its UTF-8 bytes.

Where the lowest rank occurs at several places of a sequence, they are merged in one round as far as one merge after
another from the left would take them: up to the first whose new neighbours have a rank as low (`_take`). So rounds
follow the distinct ranks of a sequence and not its length, and results are those of the library for any vocabulary.
A pre-token of more than `LONG` characters takes a queue of pairs instead (`count_long`), which is exact as well and
does not go through the whole sequence once a round.

Counts of pre-tokens are kept from batch to batch up to a bound; beyond it they are counted again. The model file is
read by the driver and broadcast (32 000 tokens here).

Defined cases: a null text is empty and has no tokens and no bytes; repeated rows are counted one by one; all columns
come back in the struct `doc` as they are; an empty table gives an empty result. A model with user-defined or unused
tokens, or without byte tokens, raises: it would need other rules.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospark.llm.chunks import field, packed
from prospark.llm.words import buffers

BATCH_BYTES = 4_000_000
#: Pre-tokens that a worker keeps from one batch to the next, and the bytes of the longest one kept.
KEPT_PIECES = 500_000
KEPT_BYTES = 64
#: Characters of the longest pre-token that is merged in arrays.
LONG = 4096
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Tokens by number, and for each pair of tokens the token it merges to with its rank; low ranks merge first."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        number = range(lib.get_piece_size())
        if any(lib.is_unused(i) for i in number) or not any(lib.is_byte(i) for i in number):
            raise ValueError("the model has unused tokens or no byte tokens")
        names = {lib.id_to_piece(i): lib.get_score(i) for i in number if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))}
        self.names = list(names)
        by_name = {name: i for i, name in enumerate(self.names)}
        # Equal scores share a rank: the leftmost pair goes first.
        scores = np.array(list(names.values()))
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        merged = {}
        for name, i in by_name.items():
            for k in range(1, len(name)):
                a, b = by_name.get(name[:k]), by_name.get(name[k:])
                if a is not None and b is not None:
                    merged[a << 32 | b] = i
        self.keys = np.array(sorted(merged), dtype=np.int64)
        self.token = np.array([merged[k] for k in self.keys.tolist()], dtype=np.int64)
        #: Token of each code point, -1 where there is none.
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for name, i in by_name.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        letters = sorted({c for name in self.names for c in name})
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1,) * 2, dtype=bool)
        for name in self.names:
            own = self.letter[np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32)]
            self.beside[own[:-1], own[1:]] = True

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, token) of the merge of each pair; rank `_NONE` where they do not merge."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        token = self.token[at]
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[token], _NONE), token


def _take(rank: np.ndarray, owner: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the lowest-rank places `at` one merge after another from the left would take before any other rank.

    `before` and `after` are the ranks of the pairs that a merge makes with its neighbours. The first merge of a
    sequence with one as low as its own rank ends the round for that sequence, itself included.
    """
    ends = np.minimum(before, after) <= rank[at]
    earlier = np.cumsum(ends) - ends
    own = owner[at]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return earlier == np.repeat(earlier[first], np.diff(np.append(first, len(at))))


def count_merged(vocabulary: Vocabulary, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Symbols that survive in each sequence; `symbols` are those of all sequences one after another, none empty."""
    out = sizes.copy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    symbols = symbols.astype(np.int64)
    rank, token = np.full(len(symbols), _NONE, dtype=np.int32), np.zeros(len(symbols), dtype=np.int64)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    rank[inner], token[inner] = vocabulary.pairs(symbols[inner], symbols[inner + 1])
    while len(symbols):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(np.append(first, len(owner)))
        least = np.minimum.reduceat(rank, first)
        done = least == _NONE
        out[owner[first[done]]] = size[done]
        if done.any():
            left = np.repeat(~done, size)
            symbols, owner, rank, token, least, size = symbols[left], owner[left], rank[left], token[left], least[~done], size[~done]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(least, size))
        # Places side by side share a symbol: every other one of a run, from its left end.
        run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        new = token[at]
        # A neighbour on the left that is merged in this round is its new symbol already.
        prior = np.where(at > 0, symbols[at - 1], -1)
        joined = np.flatnonzero(np.diff(at) == 2) + 1
        prior[joined] = new[joined - 1]
        prior[(at == 0) | (owner[at - 1] != owner[at])] = -1
        follow = np.minimum(at + 2, len(symbols) - 1)
        later = np.where((at + 2 < len(symbols)) & (owner[follow] == owner[at]), symbols[follow], -1)
        take = _take(rank, owner, at, vocabulary.pairs(prior, new)[0], vocabulary.pairs(new, later)[0])
        at, new = at[take], new[take]
        symbols[at] = new
        alive = np.ones(len(symbols), dtype=bool)
        alive[at + 1] = False
        place = np.cumsum(alive) - 1
        symbols, owner, rank, token = symbols[alive], owner[alive], rank[alive], token[alive]
        # Pairs that begin at a new symbol or at its left neighbour.
        at = place[at]
        touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
        inner = (touched + 1 < len(symbols)) & (owner[np.minimum(touched + 1, len(symbols) - 1)] == owner[touched])
        rank[touched[~inner]] = _NONE
        touched = touched[inner]
        rank[touched], token[touched] = vocabulary.pairs(symbols[touched], symbols[touched + 1])
    return out


def count_long(vocabulary: Vocabulary, symbols: np.ndarray) -> int:
    """Symbols that survive in one long sequence: a queue of pairs by rank, then place."""
    symbol, n = symbols.tolist(), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(i: int) -> tuple[int, int]:
        key = symbol[i], symbol[after[i]]
        if key not in known:
            rank, token = vocabulary.pairs(np.array(key[:1]), np.array(key[1:]))
            known[key] = int(rank[0]), int(token[0])
        return known[key]

    queue = [(pair(i)[0], i, symbol[i], symbol[i + 1]) for i in range(n - 1)]
    queue = [x for x in queue if x[0] != _NONE]
    heapq.heapify(queue)
    alive = n
    while queue:
        rank, i, a, b = heapq.heappop(queue)
        j = after[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue
        symbol[i], symbol[j] = pair(i)[1], -1
        after[i] = after[j]
        alive -= 1
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := pair(k)[0]) != _NONE:
                heapq.heappush(queue, (r, k, symbol[k], symbol[after[k]]))
    return alive


class Counter:
    """Tokens of texts, with the counts of pre-tokens seen before."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known, self.count = pa.array([], pa.string()), np.zeros(0, dtype=np.int64)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte of each pre-token, pre-tokens of each text) of UTF-8 texts one after another."""
        char = np.flatnonzero((data & 0xC0) != 0x80)
        letter = self.vocabulary.letter[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)]
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[char[1:][~self.vocabulary.beside[letter[:-1], letter[1:]]]] = True
        begins[offsets] = True
        start = np.flatnonzero(begins[: len(data)])
        return start, np.diff(np.searchsorted(start, offsets))

    def tokens(self, pieces: pa.Array) -> np.ndarray:
        """Tokens of each pre-token."""
        data, offsets = buffers(pieces)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        symbol = self.vocabulary.of_char[code]
        ends = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
        sizes = np.diff(ends)
        # A character without a token stands alone: it stands beside no other in a token.
        out = np.where(symbol[ends[:-1]] >= 0, 0, np.diff(offsets))
        long = (out == 0) & (sizes > LONG)
        short = np.flatnonzero((out == 0) & ~long)
        keep = np.repeat((out == 0) & ~long, sizes)
        out[short] = count_merged(self.vocabulary, symbol[keep], sizes[short])
        for i in np.flatnonzero(long).tolist():
            out[i] = count_long(self.vocabulary, symbol[ends[i] : ends[i + 1]])
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        data, offsets = buffers(pa.array(self.vocabulary.library.normalize(texts), pa.large_string()))
        if not len(data):
            return np.zeros(len(texts), dtype=np.int64)
        start, per_text = self.cut(data, offsets)
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(data))
        pieces = pieces.dictionary_encode()
        distinct = pieces.dictionary.cast(pa.string()) if len(data) < 1 << 31 else pieces.dictionary
        known = self.known.cast(distinct.type)
        found = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy()
        count = np.append(self.count, 0)[found]
        new = np.flatnonzero(found < 0)
        if len(new):
            names = distinct.take(pa.array(new))
            count[new] = self.tokens(names)
            kept = np.flatnonzero(pc.binary_length(names).to_numpy() <= KEPT_BYTES)[: KEPT_PIECES - len(self.known)]
            self.known = pa.concat_arrays([self.known, names.take(pa.array(kept)).cast(pa.string())])
            self.count = np.concatenate([self.count, count[new[kept]]])
        total = np.concatenate(([0], np.cumsum(count[pieces.indices.to_numpy()])))
        ends = np.cumsum(per_text)
        return total[ends] - total[ends - per_text]


@functools.lru_cache(maxsize=1)
def _counter(model: bytes) -> Counter:
    """One counter per Python worker: later tasks of a worker find its pre-tokens."""
    return Counter(Vocabulary(model))


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """`doc` (all columns), n_bytes, n_tokens and over_limit (more than `limit` tokens)."""
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model.value)
        for batch in batches:
            column = field(pa.Table.from_batches([batch]), "doc", text_col)
            size = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
            before, row = np.concatenate(([0], np.cumsum(size))), 0
            while row < len(size):
                to = max(row + 1, int(np.searchsorted(before, before[row] + BATCH_BYTES, side="right")) - 1)
                tokens = counter([t or "" for t in column.slice(row, to - row).to_pylist()])
                columns = [batch.column(0).slice(row, to - row), pa.array(size[row:to]), pa.array(tokens), pa.array(tokens > limit)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n_bytes", "n_tokens", "over_limit"])
                row = to

    rows = packed(docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType, False)])
    for name, kind in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())):
        schema.add(name, kind)
    return rows.mapInArrow(run, schema)
