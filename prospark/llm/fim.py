"""Fill-in-middle transformation by displacement scatter.

A text is cut at two line ends into prefix, middle and suffix, and its parts are set in another order behind markers.
The texts of a batch are one array of bytes. One scan gives all line ends, so a document's cuts are two lookups. Every
byte moves by a shift that is constant within its part: the shifts' differences are written at the parts' first bytes,
their running sum is the shift of every byte, and one scatter builds all outputs. `restore` finds the markers in the
outputs alone, sums up the inverse shifts the same way and gathers the texts back.

Choices come from the first four 8-digit groups of the hex sha256 of `seed:doc_id`: the first two choose the cuts, the
third whether a text is transformed, the fourth the order of its parts.

Defined cases: a null text is empty; empty texts and texts that contain a marker stay as they are (`plain`, no parts);
a null doc_id hashes as no digits, repeated rows are transformed alike; all columns come back in the struct `doc`; an
empty table gives an empty result. Markers that could be mistaken across a joint (one ends as another begins) raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospark.llm.chunks import field, packed
from prospark.llm.words import buffers

MARKERS = ("<P>", "<S>", "<M>")
BATCH_BYTES = 8_000_000
_NEWLINE = 0x0A
PLAIN, PSM, SPM = "plain", "psm", "spm"


def checked(markers: tuple[str, str, str]) -> list[np.ndarray]:
    """The markers' bytes, if no two of them can overlap."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + (i != j)))):
                raise ValueError(f"markers {markers} can overlap")
    return [np.frombuffer(m.encode(), dtype=np.uint8) for m in markers]


def hash_parts(seed: int, doc_id: Column) -> list[Column]:
    """The four numbers that choose a document's cuts and form."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes behind each line, number of the first line of each text and of what follows the last)."""
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[1:] = data == _NEWLINE
    ends[offsets[1:][np.diff(offsets) > 0]] = True
    ends = np.flatnonzero(ends)
    return ends, np.searchsorted(ends, offsets, side="right")


def moved(data: np.ndarray, start: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """`size` bytes with the segments of `data` that begin at `start` (ascending, from 0) scattered to `to`; gaps are 0."""
    out = np.zeros(size, dtype=np.uint8)
    if len(data):
        # Of segments that begin at one byte all but the last are empty.
        last = np.append(start[1:] != start[:-1], True) & (start < len(data))
        start, shift = start[last], (to - start)[last]
        step = np.zeros(len(data), dtype=np.int64)
        step[start] = np.diff(shift, prepend=0)
        out[np.cumsum(step) + np.arange(len(data))] = data
    return out


def transform(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray, spm: np.ndarray, h1: np.ndarray, h2: np.ndarray, markers: list[np.ndarray]):
    """(output bytes, their offsets, lines of each text, first and second cut) of texts one after another."""
    ends, line = line_ends(data, offsets)
    n = np.diff(line)
    a, b = h1 % (n + 1), h2 % (n + 1)

    def place(k: np.ndarray) -> np.ndarray:
        return np.where(k == 0, offsets[:-1], ends[np.minimum(line[:-1] + np.maximum(k, 1), len(ends)) - 1] if len(ends) else offsets[:-1])

    first, second = place(np.minimum(a, b)), place(np.maximum(a, b))
    first, second = np.where(plain, offsets[:-1], first), np.where(plain, offsets[:-1], second)
    p, s, m = (len(x) for x in markers)
    begin = offsets[:-1] + np.concatenate(([0], np.cumsum(np.where(plain, 0, p + s + m))[:-1])) if len(n) else offsets[:0]
    prefix, middle, suffix = first - offsets[:-1], second - first, offsets[1:] - second
    to_prefix = begin + np.where(spm, s + suffix + p, p)
    to_suffix = begin + np.where(spm, s, p + prefix + s)
    to_middle = begin + p + s + m + prefix + suffix
    to_prefix, to_suffix, to_middle = np.where(plain, begin, to_prefix), np.where(plain, begin, to_suffix), np.where(plain, begin, to_middle)
    total = np.append(begin, len(data) + int(np.sum(~plain)) * (p + s + m))
    start = np.stack([offsets[:-1], first, second], axis=1).reshape(-1)
    out = moved(data, start, np.stack([to_prefix, to_middle, to_suffix], axis=1).reshape(-1), int(total[-1]))
    for marker, at in zip(markers, (to_prefix - p, to_suffix - s, to_middle - m)):
        out[at[~plain][:, None] + np.arange(len(marker))] = marker
    return out, total, n, first, second


def restore(data: np.ndarray, offsets: np.ndarray, plain: np.ndarray, spm: np.ndarray, markers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text bytes, their offsets) from outputs and forms; an output that is not plain has each marker exactly once."""
    made = np.flatnonzero(~plain)
    end = offsets[1:][made]
    after, size = [], [len(m) for m in markers]
    for marker in markers:
        at = np.flatnonzero(data[: len(data) - len(marker) + 1] == marker[0]) if len(data) >= len(marker) else np.zeros(0, dtype=np.int64)
        for k in range(1, len(marker)):
            at = at[data[at + k] == marker[k]]
        owner = np.searchsorted(offsets, at, side="right") - 1
        # Not across the end of an output, and not what a plain text has of its own.
        inside = ~plain[owner] & (at + len(marker) <= offsets[owner + 1])
        if not np.array_equal(owner[inside], made):
            raise ValueError("an output does not have each marker once")
        after.append(at[inside] + len(marker))
    p, s, m = after
    spm = spm[made]
    prefix = np.where(spm, m - size[2], s - size[1]) - p
    suffix = np.where(spm, p - size[0], m - size[2]) - s
    middle = end - m
    length = np.diff(offsets)
    length[made] -= sum(size)
    total = np.concatenate(([0], np.cumsum(length)))
    text = total[:-1]
    start = np.stack([text, text, text], axis=1)
    source = np.repeat(offsets[:-1][:, None], 3, axis=1)
    start[made] = np.stack([text[made], text[made] + prefix, text[made] + prefix + middle], axis=1)
    source[made] = np.stack([p, m, s], axis=1)
    out = np.zeros(int(total[-1]), dtype=np.uint8)
    if len(out):
        start, source = start.reshape(-1), source.reshape(-1)
        last = np.append(start[1:] != start[:-1], True) & (start < len(out))
        # A part may be empty although nothing else begins there: the next part's first byte decides.
        step = np.zeros(len(out), dtype=np.int64)
        step[start[last]] = np.diff((source - start)[last], prepend=0)
        out = data[np.cumsum(step) + np.arange(len(out))]
    return out, total


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _slabs(column: pa.Array) -> Iterator[tuple[int, int]]:
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    before, row = np.concatenate(([0], np.cumsum(size))), 0
    while row < len(size):
        to = max(row + 1, int(np.searchsorted(before, before[row] + BATCH_BYTES, side="right")) - 1)
        yield row, to
        row = to


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    rate: int = 100,
    spm_percent: int = 50,
    markers: tuple[str, str, str] = MARKERS,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """`doc` (all columns), n (lines), form, prefix_chars and middle_chars (null if plain) and `output`.

    `rate` of 100 texts are transformed, `spm_percent` of 100 of those with the suffix first.
    """
    own = checked(markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = field(pa.Table.from_batches([batch]), "doc", text_col)
            numbers = [batch.column(k).to_numpy() for k in range(1, 5)]
            for a, b in _slabs(column):
                texts = column.slice(a, b - a)
                h1, h2, h3, h4 = (x[a:b] for x in numbers)
                data, offsets = buffers(texts)
                plain = (np.diff(offsets) == 0) | (h3 % 100 >= rate)
                for marker in markers:
                    plain |= pc.fill_null(pc.match_substring(texts, marker), False).to_numpy(zero_copy_only=False)
                spm = (h4 % 100 < spm_percent) & ~plain
                out, total, n, first, second = transform(data, offsets, plain, spm, h1, h2, own)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(n),
                        pa.array(np.where(plain, PLAIN, np.where(spm, SPM, PSM)).tolist(), pa.string()),
                        pa.array(chars[first] - chars[offsets[:-1]], mask=plain),
                        pa.array(chars[second] - chars[first], mask=plain),
                        _strings(out, total),
                    ],
                    ["doc", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    rows = packed(docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string")), *hash_parts(seed, F.col(f"`{id_col}`")))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType, False)])
    for name, kind in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())):
        schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def restored(rows: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """`rows` with their column `restored`: the text rebuilt from `output` and `form` alone."""
    own = checked(markers)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output, form = batch.column(names.index("output")), batch.column(names.index("form"))
            for a, b in _slabs(output):
                data, offsets = buffers(output.slice(a, b - a))
                forms = form.slice(a, b - a)
                text, total = restore(data, offsets, *(pc.equal(forms, f).to_numpy(zero_copy_only=False) for f in (PLAIN, SPM)), own)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, _strings(text, total)], [*names, "restored"])

    schema = T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())])
    return rows.mapInArrow(run, schema)
