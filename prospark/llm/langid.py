"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of pieces of its training texts. A text is brought to lower
case letters and single spaces, cut into blocks, and every block is compressed with each dictionary alone; the language
with the smallest sum of sizes wins. Blocks keep the dictionary, and not the text's own past, what a block is matched
against. The relative gap between the two smallest sums is the score; a gap under `least_gap` is marked as rejected.
Equal sums go to the language with more training texts.

Training takes one piece from `pieces` texts per language, chosen by a hash of the row: at most pieces * piece_chars
characters per language go through the driver, whatever the size of the corpus. All texts of a language are equally
likely, and a piece's place in its text comes from the hash too. Predictions are made inside tasks, without exchange.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any training text everything is
`und`; null languages are not learned; a null doc_id is not held out and not learned from; repeated rows are judged one
by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIECES, PIECE_CHARS = 200, 500
MOST_LANGUAGES = 500
BLOCK_BYTES, LEVEL = 2048, 5

#: What is neither a letter nor a mark that stands on one: vowel signs are part of their words.
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> str:
    """The words of a text, lower case; nothing if it has no letter."""
    words = _OTHER.sub(" ", text.lower()).strip()
    return words if _LETTER.search(words) else ""


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """Raw-content dictionaries, the language with the most training texts first."""

    def __init__(self, pieces: dict[str, list[str]], counts: dict[str, int]):
        self.langs = sorted(pieces, key=lambda lang: (-counts[lang], lang))
        self.dictionaries = [" ".join(plain(p) for p in pieces[lang]).encode() for lang in self.langs]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in self.dictionaries:
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def predict(model: Model, compressors: list, text: str | None) -> tuple[str, float]:
    """(language, relative gap to the next one)."""
    bare = plain(text or "").encode()
    if not bare or not model.langs or not any(c.isalpha() for c in bare.decode()):
        return "und", 0.0
    blocks = [bare[a : a + BLOCK_BYTES] for a in range(0, len(bare), BLOCK_BYTES)]
    sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in compressors])
    best = int(sizes.argmin())
    if len(sizes) == 1:
        return model.langs[best], 1.0
    rest = np.delete(sizes, best).min()
    return model.langs[best], float(rest - sizes[best]) / float(rest)


def train(docs: DataFrame, pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> Model:
    """Dictionaries from rows with text and lang that are not held out."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # A few times more rows than wanted pass the hash bound of their language; the ones with the smallest hashes stay.
    bound = F.lit(0.0)
    for lang, n in counts.items():
        bound = F.when(F.col("lang") == lang, F.lit(min(1.0, 4.0 * pieces / n))).otherwise(bound)
    drawn = rows.select("lang", "text", F.xxhash64("doc_id", F.lit(17)).alias("h"))
    drawn = drawn.where(F.pmod("h", F.lit(1 << 30)) < bound * (1 << 30))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.char_length("text") - piece_chars, F.lit(1))) + 1
    drawn = drawn.select("lang", "h", F.substring(F.col("text"), place.cast("int"), F.lit(piece_chars)).alias("piece"))
    order = Window.partitionBy("lang").orderBy("h", "piece")
    chosen = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pieces).select("lang", "piece", "k")
    found: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["k"])):
        found.setdefault(r["lang"], []).append(r["piece"])
    return Model(found, counts)


def identify(docs: DataFrame, model: Model, least_gap: float = 0.01) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row per row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        compressors = known.compressors()
        for batch in batches:
            got = [predict(known, compressors, t) for t in batch.column(2).to_pylist()]
            score = np.array([s for _, s in got], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array(score), pa.array(score < least_gap)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
