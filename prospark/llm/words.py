"""Words, word names and window names of Arrow text columns, computed on whole byte buffers.

A name is a 64-bit number that depends on the bytes of a word (or on the names in a window) alone, so equal
words have one name in every task of every job and nothing has to be exchanged to agree on it. A word's name takes in
eight bytes after another, each step through a mixing of all bits, so no rule makes different words meet; words of
more than `LONG_WORD` bytes are named by a keyed BLAKE2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; a longer document is one slab of its own.
SLAB_BYTES = 1 << 18

LONG_WORD = 256
_KEY = b"prospark words"


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A") : ord("Z") + 1] += 32
#: The first n of eight bytes, lowest first.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the words at data[start:end]."""
    size = end - start
    name = mix(size.astype(np.uint64) * _STEP + np.uint64(0xD1B54A32D192ED03))
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    active = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        active = active[size[active] > at]
        if not len(active):
            break
        part = np.ascontiguousarray(eights[start[active] + at]).view("<u8").reshape(-1)
        part = part & _FIRST[np.minimum(size[active] - at, 8)]
        name[active] = mix((name[active] ^ part) + _STEP)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=_KEY).digest()
        name[i] = np.uint64(int.from_bytes(digest, "little"))
    return name


#: Byte tables: True where a byte separates words.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
PUNCT = np.zeros(256, dtype=bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


class Words:
    """The words of some documents one after another.

    `first[d]:first[d+1]` are document d's words, `start`/`end` their bytes in `data`, `name` their names.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~separators[data] if n else np.zeros(0, dtype=bool)
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        stop = np.zeros(n + 1, dtype=bool)
        stop[1:] = word
        stop[1:-1] &= ~word[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begin[edge] = word[edge]
        stop[edge] = word[edge - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets)
        self.name = word_names(_LOWERED[data] if lower else data, self.start, self.end)
        self.docs = len(offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(self.docs), self.counts)


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xA24BAED4963EE407) + (b ^ np.uint64(0x9FB21C651E98DF25)) * np.uint64(0xD6E8FEB86659FD93))


def window_names(name: np.ndarray, width: int) -> np.ndarray:
    """Names of all runs of `width` names, by doubling; one for each start, windows over document ends included."""
    if len(name) < width:
        return np.zeros(0, dtype=np.uint64)
    total, out, at, size, block = len(name) - width + 1, None, 0, 1, name
    while True:
        if width & size:
            part = block[at : at + total]
            out = part if out is None else pair_names(out, part)
            at += size
        if size * 2 > width:
            # One more mixing keeps windows of a power-of-two width apart from their halves' names.
            return mix(out + np.uint64(width))
        block = pair_names(block[: len(block) - size], block[size:])
        size *= 2


def window_fits(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """True at each start whose window of `width` words stays inside its document."""
    ok = np.zeros(total, dtype=bool)
    if len(first) > 1:
        step = np.zeros(total + 1, dtype=np.int64)
        sizes = np.diff(first)
        at, to = first[:-1][sizes >= width], first[1:][sizes >= width] - width + 1
        np.add.at(step, at, 1)
        np.add.at(step, to, -1)
        ok = np.cumsum(step[:total]) > 0
    return ok


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is the empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(column: pa.Array | pa.ChunkedArray, separators: np.ndarray, lower: bool) -> Iterator[tuple[int, Words]]:
    """(number of the first row, words) of consecutive rows, about SLAB_BYTES of text at a time."""
    done = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        data, offsets = buffers(part)
        row = 0
        while row < len(part):
            to = int(np.searchsorted(offsets, offsets[row] + SLAB_BYTES, side="right")) - 1
            to = min(max(to, row + 1), len(part))
            yield done + row, Words(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], separators, lower)
            row = to
        done += len(part)


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
