"""Token ids in files of bit or byte planes.

Documents are dealt by ranges of doc_id into parts; a part holds its documents' ids one after another, cut into blocks
of `BLOCK_IDS` ids. A block is transposed into planes (the lowest bytes or bits of all ids, then the next), each plane
is compressed with zstandard, and its row names the documents it holds with their number of ids in the block. Blocks
are rows of a Parquet table `blocks`; the chunk index is the table `index`: (part, block, start, n_ids, n_bytes), start
being the ids of all blocks before it. A reader of some ids needs the index and the blocks it names, nothing else.

Every id goes through one range exchange of the texts; ids are never exchanged. A reading task takes any blocks in any
order: a document's pieces from several blocks are put together by their checksums.

Texts are encoded by the tokenizers library with its defaults: the string of an added token inside a text is that
token. A text is cut between an ASCII letter and an ASCII character that is none, and before each space that stands
between two characters which are no white space. The pre-tokenizer splits at both, so a piece is encoded alike wherever
it stands: each distinct piece is encoded once per batch or found among those kept. A text that contains the string of
an added token is one piece.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; repeated doc_ids are separate
documents, in the order of their texts, and ranges also divide them by the first characters of their texts; an empty table writes no blocks and reads back as no rows; other columns are
not read.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospark.llm.chunks import partitions_for, text_bytes
from prospark.llm.words import buffers

BLOCK_IDS = 1 << 16
#: Pieces that an encoder keeps from one batch to the next, and the bytes of the longest one kept.
KEPT_PIECES = 500_000
KEPT_BYTES = 64
_BATCH_BYTES = 8_000_000
_SPACE = 0x20
#: Bytes that are white space or may begin or end some: ASCII, and the first bytes of U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000.
_WIDE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_BLANK_OR_LEAD = _BLANK.copy()
_BLANK_OR_LEAD[list(_WIDE_LEADS)] = True
_WIDE_LEAD = _BLANK_OR_LEAD & ~_BLANK
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_OTHER = ~_LETTER & (np.arange(256) < 0x80)


def cut_pieces(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each piece, pieces of each text) of UTF-8 texts one after another; `whole` texts are not cut.

    A character that may be white space by its first byte counts as such: then there is no cut, and the piece is longer.
    """
    at = np.flatnonzero(data == _SPACE)
    at = at[(at > 0) & (at < len(data) - 1)]
    blank = _BLANK_OR_LEAD[data[at + 1]] | _BLANK[data[at - 1]]
    blank |= (data[at - 1] >= 0x80) & (_WIDE_LEAD[data[np.maximum(at - 2, 0)]] | _WIDE_LEAD[data[np.maximum(at - 3, 0)]])
    at = np.concatenate([at[~blank], np.flatnonzero(_LETTER[data[:-1]] & _OTHER[data[1:]]) + 1])
    if whole.any():
        at = at[~whole[np.searchsorted(offsets, at, side="right") - 1]]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[at] = True
    begins[offsets] = True
    start = np.flatnonzero(begins[: len(data)])
    return start, np.diff(np.searchsorted(start, offsets))


class Encoder:
    """Ids of texts under a byte-level tokenizers file that splits before a space between other characters."""

    def __init__(self, tokenizer_json: str, end_id: int | None = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Added tokens that a piece of a space and letters could contain.
        self.lettered = [a for a in self.added if a.lstrip(" ").isalpha()]
        self.end = [] if end_id is None else [end_id]
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocab.items() if token[0] == "Ġ"]] = True  # the byte symbol of a space
        #: Kept pieces and their unit numbers.
        self.known, self.unit = pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
        self.flat, self.at = np.zeros(1 << 20, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Stores units and returns the number of the first."""
        first, used = len(self.at) - 1, self.at[-1]
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.at = np.concatenate([self.at, used + np.cumsum(sizes)])
        return first

    def _units(self, pieces: list[str]) -> np.ndarray:
        """Stores the ids of pieces and returns their unit numbers. Pieces of a space and letters are encoded many in one text."""
        unit = np.zeros(len(pieces), dtype=np.int64)
        joined = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        if self.lettered:
            joined = [i for i in joined if not any(a in pieces[i] for a in self.lettered)]
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        alone = np.ones(len(pieces), dtype=bool)
        for group, ids in zip(groups, self.plain(["".join([pieces[i] for i in g]) for g in groups])):
            ids = np.array(ids, dtype=np.uint32)
            first = np.flatnonzero(self.opens[ids])
            if len(first) == len(group) and first[0] == 0:
                n = self._add(ids, np.diff(np.append(first, len(ids))))
                unit[group] = np.arange(n, n + len(group))
                alone[group] = False
        rest = np.flatnonzero(alone)
        if len(rest):
            n = self._add(*_ragged(self.plain([pieces[i] for i in rest.tolist()])))
            unit[rest] = np.arange(n, n + len(rest))
        return unit

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text), end ids included; null is the empty text."""
        data, offsets = buffers(column)
        whole = np.zeros(len(column), dtype=bool)
        for content in self.added:
            whole |= pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)
        start, per_text = cut_pieces(data, offsets, whole)
        spans = np.append(start, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(start), pa.py_buffer(spans), pa.py_buffer(data)).dictionary_encode()
        distinct = pieces.dictionary
        found = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy()
        unit = np.append(self.unit, -1)[found]
        new = np.flatnonzero(found < 0)
        kept = new[pc.binary_length(distinct).to_numpy()[new] <= KEPT_BYTES][: KEPT_PIECES - len(self.known)]
        # Kept pieces are stored first; what follows them is forgotten after this batch.
        if len(kept):
            names = distinct.take(pa.array(kept))
            unit[kept] = self._units(names.to_pylist())
            self.known, self.unit = pa.concat_arrays([self.known, names]), np.concatenate([self.unit, unit[kept]])
        learned = len(self.at)
        rest = np.flatnonzero(unit < 0)
        unit[rest] = self._units(distinct.take(pa.array(rest)).to_pylist())
        end = self._add(np.array(self.end, dtype=np.uint32), np.array([len(self.end)]))
        # One unit per piece, and the end after each text's pieces.
        last = np.cumsum(per_text + 1) - 1
        order = np.full(len(start) + len(per_text), end, dtype=np.int64)
        inside = np.ones(len(order), dtype=bool)
        inside[last] = False
        order[inside] = unit[pieces.indices.to_numpy()]
        size = self.at[order + 1] - self.at[order]
        to = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[order] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]
        self.at = self.at[:learned]
        return ids, np.diff(np.concatenate(([0], to[last]))) if len(last) else np.zeros(0, dtype=np.int64)


@functools.lru_cache(maxsize=1)
def _encoder(tokenizer_json: str, end_id: int | None) -> Encoder:
    """One encoder per Python worker: later tasks of a worker find its pieces."""
    return Encoder(tokenizer_json, end_id)


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter((i for x in lists for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes


def pack(ids: np.ndarray, planes: str = "byte", level: int = 3) -> tuple[int, list[bytes]]:
    """(bytes of an id, compressed planes), lowest plane first."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    rows = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    if planes == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1).reshape(width, -1, 8).transpose(0, 2, 1)[:, ::-1].reshape(8 * width, -1), axis=1)
    zip_ = zstandard.ZstdCompressor(level=level)
    return width, [zip_.compress(np.ascontiguousarray(r).tobytes()) for r in rows]


def unpack(n: int, width: int, planes: list[bytes]) -> np.ndarray:
    """Ids of a block; as many planes as bytes are byte planes, eight times as many bit planes."""
    unzip = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(unzip.decompress(p), dtype=np.uint8) for p in planes]
    if len(planes) == 8 * width:
        bits = np.stack([np.unpackbits(r, count=n) for r in rows]).reshape(width, 8, n)[:, ::-1]
        rows = list(np.packbits(bits.transpose(0, 2, 1).reshape(width, -1), axis=1))
    return np.ascontiguousarray(np.stack(rows, axis=1)).view(f"<u{width}").reshape(-1).astype(np.uint32)


_BLOCKS = "part int, block int, at long, n_ids int, width int, planes array<binary>, first_doc long, docs array<long>, counts array<int>"
_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]


def _write_blocks(tokenizer_json, end_id: int | None, planes: str, level: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_json.value, end_id)
        part, block, at, n_doc = TaskContext.get().partitionId(), 0, 0, 0
        ids, docs, counts = np.zeros(0, dtype=np.uint32), [], []

        def cut(full: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs, counts, block, at, n_doc
            done, i, left = 0, 0, counts
            while len(ids) - done >= block_ids or (not full and done < len(ids)):
                n = min(block_ids, len(ids) - done)
                own, take, first = [], [], n_doc + i
                room = n
                while room:
                    k = min(left[i], room)
                    own.append(docs[i])
                    take.append(k)
                    room -= k
                    left[i] -= k
                    if not left[i]:
                        i += 1
                width, packed = pack(ids[done : done + n], planes, level)
                row = (part, block, at, n, width, packed, first, own, take)
                yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, _TYPES)], _NAMES)
                block, at, done = block + 1, at + n, done + n
            ids, docs, counts, n_doc = ids[done:], docs[i:], left[i:], n_doc + i

        for batch in batches:
            texts, row = batch.column(1), 0
            before = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))))
            while row < len(texts):
                to = max(row + 1, int(np.searchsorted(before, before[row] + _BATCH_BYTES, side="right")) - 1)
                new, sizes = encoder.encode(texts.slice(row, to - row))
                ids = np.concatenate([ids, new])
                keep = np.flatnonzero(sizes) if end_id is None else np.arange(len(sizes))
                own = batch.column(0).slice(row, to - row).to_pylist()
                docs, counts = docs + [own[k] for k in keep], counts + sizes[keep].tolist()
                yield from cut(True)
                row = to
        yield from cut(False)

    return run


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int | None = 0,
    planes: str = "byte",
    level: int = 3,
    block_ids: int = BLOCK_IDS,
    part_bytes: int = 16 << 20,
) -> None:
    """Encodes all texts and writes blocks and chunk index below `path`, in ascending doc_id order."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer_json = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = partitions_for(rows, text_bytes(rows), part_bytes)
    rows = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    blocks = rows.mapInArrow(_write_blocks(tokenizer_json, end_id, planes, level, block_ids), _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    kept = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    sizes = F.aggregate(F.transform("planes", F.octet_length), F.lit(0), lambda a, b: a + b)
    slim = kept.select("part", "block", "at", "n_ids", sizes.alias("n_bytes"))
    starts = part_starts(slim)
    slim.join(starts, "part").select("part", "block", (F.col("start") + F.col("at")).alias("start"), "n_ids", "n_bytes").write.parquet(f"{path}/index")


def part_starts(blocks: DataFrame) -> DataFrame:
    """(part, start): ids of all parts before it. One row per part meets in one task, not one per document."""
    parts = blocks.groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


_PIECES = "part int, block int, n_doc long, doc_id long, at long, n int, crc long, ids array<long>"


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document and block: place, number, checksum and, if asked for, the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["n_ids"], r["width"], r["planes"]).astype("<u4")
                ends = np.cumsum(r["counts"])
                firsts = ends - r["counts"]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, r["part"], dtype=np.int32)),
                        pa.array(np.full(n, r["block"], dtype=np.int32)),
                        pa.array(r["first_doc"] + np.arange(n)),
                        pa.array(r["docs"], pa.int64()),
                        pa.array(r["at"] + firsts),
                        pa.array(r["counts"], pa.int32()),
                        pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(firsts, ends)], pa.int64()),
                        pa.array([ids[a:b].tolist() if with_ids else None for a, b in zip(firsts, ends)], pa.list_(pa.int64())),
                    ],
                    [c.split()[0] for c in _PIECES.split(", ")],
                )

    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, _PIECES)


def _times_x(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@functools.cache
def _zeros(power: int) -> list[int]:
    """The matrix that carries a checksum over 2**power zero bits."""
    if power == 0:
        return [0xEDB88320] + [1 << i for i in range(31)]  # fixed value: the CRC-32 polynomial
    half = _zeros(power - 1)
    return [_times_x(half, column) for column in half]


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """Checksum of two byte strings one after another, from theirs: the first is carried over the second's zeros."""
    bits, power = 8 * second_bytes, 0
    while bits >> power:
        if bits >> power & 1:
            first = _times_x(_zeros(power), first)
        power += 1
    return first ^ second


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at `path`."""
    pieces = read_pieces(spark, path).select("part", "block", "n_doc", "doc_id", "at", "n", "crc")
    starts = spark.read.schema("part int, block int, start long, n_ids int, n_bytes int").parquet(f"{path}/index").groupBy("part").agg(F.min("start").alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for many in batch.column(4).to_pylist():
                crc = 0
                for x in many:
                    crc = joined_crc(crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = pieces.groupBy("part", "n_doc").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("at").alias("at"),
        F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"),
    )
    rows = docs.select("part", "doc_id", "at", "n_tokens", "pieces").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "part").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
