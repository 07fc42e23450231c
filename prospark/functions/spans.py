"""Runs of whole words in Arrow text columns, named by 64-bit numbers on whole byte buffers.

Equal runs have equal names in every task. Unequal runs may share one, so a name finds candidates and decides nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes named at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
_SPACE = 0x20
_BASE = 0x100000001B3
_DOWN = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Runs:
    """Words of texts whose words stand one space apart, and names of their runs."""

    def __init__(self, column: pa.Array):
        texts = pc.fill_null(column, "").cast(pa.large_string())
        _, where, data = texts.buffers()
        at = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        offsets = at - at[0]
        edge = np.zeros(len(data) + 1, dtype=bool)
        word = np.zeros(len(data) + 1, dtype=bool)
        word[:-1] = data != _SPACE
        edge[offsets] = True
        behind = np.concatenate(([False], word[:-1]))
        self.start = np.flatnonzero(word & (edge | ~behind))
        self.end = np.flatnonzero(behind & (edge | ~word))
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
        self._sums, self._down = sums, _powers(_DOWN, len(data) + 1)

    def names(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Names of the runs from word `first` to word `last`, as signed numbers."""
        a, b = self.start[first], self.end[last]
        return _mixed((self._sums[b] - self._sums[a]) * self._down[a]).view(np.int64)

    def of_size(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, name) of every run of `n` words inside one text."""
        first = np.arange(max(0, len(self.start) - n + 1))
        first = first[self.row[first] == self.row[first + n - 1]]
        return self.row[first], self.names(first, first + n - 1)


def batches_of(column: pa.Array, batch_bytes: int = BATCH_BYTES):
    """(first row, last row) of slices of about `batch_bytes` of text."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before, row = np.concatenate(([0], np.cumsum(size))), 0
    while row < len(size):
        to = max(row + 1, int(np.searchsorted(before, before[row] + batch_bytes, side="right")) - 1)
        yield row, to
        row = to


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of `values` stand in the ascending `wanted`."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return wanted[at] == values
