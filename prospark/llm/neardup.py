"""Near-duplicate documents by min-max hashing.

The set of a document holds the names of its distinct `width`-word shingles. Under each of 63 permutations both the
smallest and the largest value are kept, which makes 126 signature values of 63 hash evaluations; bands of them name
the buckets. The bands are as long as they can be for less than one pair in a million of the wanted similarity to miss
all common buckets: 25 bands of 5 values at 0.85, 31 of 4 at 0.8.

Documents with equal sets are one class, named by its smallest doc_id, before anything is paired. In a bucket each class
is paired with the smallest one, its leader, only: pairs grow with the bucket and not with its square. A pair is decided
on the two whole sets, and the decision also gives the symmetric difference D(x) of a class x and its leader. Two
classes of one bucket that are not both linked to the leader can be linked only if D(x) and D(y) share at least
(|D(x)| + |D(y)| - t) / 2 elements, t = (1-s)/(1+s) of both sizes; with the rarest elements first, a join of the necessary
prefixes with length and position bounds finds all such pairs, which D(x) and D(y) then decide exactly. Classes that
leaders' links have joined already are not paired. So no component misses a link between texts that share a bucket,
and no group is paired with itself.

Components are computed over classes; members get the component of their class.

Defined cases: a null or empty text, or one without words, has an empty set, is linked with nothing and kept; a row
with a null doc_id is linked with nothing, has no component and is kept; rows of one doc_id are one document (its
rows' sets are joined by a link) and are kept or go together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospark.llm.components import components
from prospark.llm.words import WHITE, Words, mix, pair_names, slabs, window_fits, window_names
from prospark.session import cut_lineage

PERMUTATIONS = 63
SALTS = 16
_FACTOR = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64))


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, first): sorted distinct shingle names of each document; a shorter text is one shingle."""
    total = len(words.name)
    names, has = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=bool)
    if total >= width:
        fits = window_fits(words.first, width, total)
        at = np.flatnonzero(fits)
        names[at] = window_names(words.name, width)[at]
        has[at] = True
    counts = words.counts
    for n in range(1, width):
        for first in words.first[:-1][counts == n]:
            names[first] = window_names(words.name[first : first + n], n)[0]
            has[first] = True
    sizes = np.add.reduceat(has, words.first[:-1][counts > 0]) if (counts > 0).any() else np.zeros(0, dtype=np.int64)
    kept, ends = names[has], np.cumsum(sizes)
    parts = [np.unique(kept[a:b]) for a, b in zip(ends - sizes, ends)]
    first = np.zeros(words.docs + 1, dtype=np.int64)
    own = np.zeros(words.docs, dtype=np.int64)
    own[counts > 0] = [len(p) for p in parts]
    np.cumsum(own, out=first[1:])
    return np.concatenate(parts) if parts else kept, first


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair of this similarity less than once in a million."""
    for rows in range(2 * PERMUTATIONS, 0, -1):
        bands = 2 * PERMUTATIONS // rows
        if (1 - (percent / 100) ** rows) ** bands <= 1e-6:
            return bands, rows
    raise ValueError(f"no banding finds a similarity of {percent} %")


def bands_of(names: np.ndarray, first: np.ndarray, bands: int, width: int) -> np.ndarray:
    """Bucket names (documents x bands) of non-empty sets that begin at `first`, from `width` values each."""
    low = np.empty((2 * PERMUTATIONS, len(first)), dtype=np.uint64)
    value = np.empty_like(names)
    for i in range(PERMUTATIONS):
        np.multiply(names ^ _SHIFT[i], _FACTOR[i], out=value)
        low[i] = np.minimum.reduceat(value, first)
        low[PERMUTATIONS + i] = np.maximum.reduceat(value, first)
    rows = low[: bands * width].reshape(bands, width, -1)
    out = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(first), axis=1)
    for r in range(width):
        out = pair_names(out, rows[:, r])
    return out.T


def signatures(docs: DataFrame, width: int = 3, percent: int = 85, text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, hi, lo, bands): a mark of the text, and size, 128-bit name and bucket names of its set."""
    n_bands, rows_of_band = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in slabs(batch.column(1), WHITE, lower=True):
                names, first = shingle_sets(words, width)
                n = np.diff(first)
                some = n > 0
                hi, lo = np.zeros(words.docs, dtype=np.uint64), np.zeros(words.docs, dtype=np.uint64)
                bands = np.zeros((0, n_bands), dtype=np.uint64)
                if some.any():
                    at = first[:-1][some]
                    hi[some] = np.add.reduceat(mix(names), at)
                    lo[some] = np.add.reduceat(mix(names ^ np.uint64(0x243F6A8885A308D3)), at)
                    bands = bands_of(names, at, n_bands, rows_of_band)
                where = np.zeros(words.docs + 1, dtype=np.int32)
                np.cumsum(some * n_bands, out=where[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, words.docs),
                        batch.column(2).slice(row, words.docs),
                        pa.array(n),
                        pa.array(hi.view(np.int64)),
                        pa.array(lo.view(np.int64)),
                        pa.ListArray.from_arrays(where, pa.array(np.ascontiguousarray(bands).reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "mark", "n_shingles", "hi", "lo", "bands"],
                )

    return _texts(docs, text_col).mapInArrow(run, "doc_id long, mark long, n_shingles long, hi long, lo long, bands array<long>")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


_VERDICT = "a long, b long, n_a long, n_b long, linked boolean, added array<long>, lost array<long>"


def _decide(width: int, percent: int):
    """Whole sets of a leader and a class: linked or not, and what the class adds to and lacks of the leader's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A hot leader's text comes with each of its classes; its set is computed once a batch.
            lead = batch.column(2).dictionary_encode()
            sets: list[np.ndarray] = []
            for _, words in slabs(lead.dictionary, WHITE, lower=True):
                names, first = shingle_sets(words, width)
                sets += [names[x:y] for x, y in zip(first[:-1], first[1:])]
            code, many = lead.indices.to_numpy(zero_copy_only=False), batch.column(4).to_pylist()
            for row, words in slabs(batch.column(3), WHITE, lower=True):
                names, first = shingle_sets(words, width)
                out: list[list] = [[] for _ in range(5)]
                for d in range(words.docs):
                    a, b = sets[code[row + d]], names[first[d] : first[d + 1]]
                    added, lost = _only(b, a), _only(a, b)
                    both = len(a) - len(lost)
                    full = many[row + d] > 2
                    for x, y in zip(out, (len(a), len(b), 100 * both >= percent * (len(a) + len(added)), *((added, lost) if full else (None, None)))):
                        x.append(y)
                at = slice(row, row + words.docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at], batch.column(1)[at], pa.array(out[0]), pa.array(out[1]), pa.array(out[2]), _lists(out[3]), _lists(out[4])],
                    ["a", "b", "n_a", "n_b", "linked", "added", "lost"],
                )

    return run


def _only(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Elements of the sorted set x that the sorted set y lacks."""
    if not len(y):
        return x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return x[y[at] != x]


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if r is None else r.view(np.int64) for r in rows], pa.list_(pa.int64()))


def _between_classes(verdicts: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Links of classes with a common leader that its own links have not joined into one component."""
    t = (100 - percent) / (100 + percent)
    rows = verdicts.where("added IS NOT NULL").select("a", "b", "n_b", F.concat("added", "lost").alias("d"))
    rows = rows.join(joined, rows["b"] == joined["node"], "left").select("a", "b", "n_b", "d", F.coalesce("component", "b").alias("c"))
    # A leader may have very many classes: they are spread over salts, and its one row is repeated for each.
    apart = rows.groupBy("a").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    apart = apart.select("a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    # Repeated rows pack so well that Spark would take them for small enough to broadcast.
    rows = rows.join(apart.hint("merge"), ["a", "salt"]).drop("salt").withColumn("size", F.size("d"))
    each = rows.select("a", "b", F.col("n_b").alias("n"), "c", "size", F.explode("d").alias("e"))
    rare = each.groupBy("a", "e").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("a", "b").orderBy("often", "e")
    each = each.join(rare, ["a", "e"]).withColumn("k", F.row_number().over(order) - 1).drop("often")
    # With one of two classes not linked to the leader, they share more than (1 - t) / 2 of the smaller difference.
    least = (1 - t) / 2 - 0.01
    x, y = each.alias("x"), each.where(f"k < size - ceil({least!r} * size) + 1").alias("y")
    need = f"ceil((x.size + y.size - {t!r} * (x.n + y.n)) / 2 - 1e-6)"
    pairs = (
        y.join(
            x,
            F.expr(
                f"""x.a = y.a AND x.e = y.e AND x.c <> y.c AND (y.size < x.size OR (y.size = x.size AND y.b < x.b))
                AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
                AND y.k <= y.size - {need} AND x.k <= x.size - {need}"""
            ),
        )
        .select("x.a", F.col("x.b").alias("b"), F.col("y.b").alias("c"))
        .distinct()
    )
    sets = rows.select("a", "b", "n_b", "d")
    pairs = pairs.join(sets, ["a", "b"]).join(sets.select("a", F.col("b").alias("c"), F.col("n_b").alias("n_c"), F.col("d").alias("f")), ["a", "c"])
    differ = F.size("d") + F.size("f") - 2 * F.size(F.array_intersect("d", "f"))
    return pairs.where(100 * (F.col("n_b") + F.col("n_c") - differ) >= percent * (F.col("n_b") + F.col("n_c") + differ)).select(F.col("b").alias("a"), F.col("c").alias("b"))


def verdicts_of(docs: DataFrame, classes: DataFrame, width: int = 3, percent: int = 85, text_col: str = "text", repeated: bool = True) -> DataFrame:
    """Each class of each bucket against the bucket's leader, decided on whole sets.

    `repeated` says whether a doc_id may stand in `docs` more than once; if not, each class has one text as it is.
    """
    rows = classes.select("rep", "mark", F.explode("bands").alias("bucket"))
    leaders = rows.groupBy("bucket").agg(F.min(F.struct("rep", "mark")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    leaders = leaders.select("bucket", "many", F.col("first.rep").alias("lead"), F.col("first.mark").alias("lead_mark"))
    stars = rows.join(leaders, "bucket").where("rep <> lead").groupBy("lead", "lead_mark", "rep", "mark").agg(F.max("many").alias("many"))
    texts = _texts(docs, text_col)
    if not repeated:
        each = stars.groupBy("lead", "rep").agg(F.max("many").alias("many"))
        with_texts = (
            each.join(texts.select(F.col("doc_id").alias("rep"), F.col("text").alias("rep_text")), "rep")
            .join(texts.select(F.col("doc_id").alias("lead"), F.col("text").alias("lead_text")), "lead")
            .select("lead", "rep", "lead_text", "rep_text", "many")
        )
        return cut_lineage(with_texts.mapInArrow(_decide(width, percent), _VERDICT))
    # One text for each class that is compared, however often its row is repeated.
    wanted = stars.select(F.col("rep").alias("doc_id"), "mark").union(stars.select("lead", "lead_mark")).distinct()
    texts = texts.join(wanted, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    # A leader of very many classes: they are spread over salts, and its text goes to those that occur.
    salt = F.when(F.col("many") > SALTS, F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(0).cast("int")
    pairs = stars.withColumn("salt", salt).join(texts.select(F.col("doc_id").alias("rep"), "mark", F.col("text").alias("rep_text")), ["rep", "mark"])
    leads = stars.select("lead", "lead_mark", salt.alias("salt")).distinct()
    leads = leads.join(texts.select(F.col("doc_id").alias("lead"), F.col("mark").alias("lead_mark"), F.col("text").alias("lead_text")), ["lead", "lead_mark"])
    with_texts = pairs.join(leads, ["lead", "lead_mark", "salt"]).select("lead", "rep", "lead_text", "rep_text", "many")
    return cut_lineage(with_texts.mapInArrow(_decide(width, percent), _VERDICT))


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` left joined with `table` on keys of which some may stand in very many rows.

    Rows are dealt to salts whatever they hold, and a key's row goes to the salts that have it.
    """
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    each = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(each, [*keys, "_salt"], "left").drop("_salt")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `docs`."""
    found = cut_lineage(signatures(docs, width, percent, text_col))
    sets = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(sets.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "mark")).alias("own"), F.first("bands").alias("bands")).select(F.col("own.doc_id").alias("rep"), "own.mark", "hi", "lo", "bands"))
    members = _looked_up(found.select("doc_id", "n_shingles", "hi", "lo"), classes.select("hi", "lo", "rep"), ["hi", "lo"]).withColumn("rep", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("rep")))
    same_id = members.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    repeated = not sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    verdicts = verdicts_of(docs, classes, width, percent, text_col, repeated)
    joined = components(verdicts.where("linked").select("a", "b").union(same_id))
    more = _between_classes(verdicts, joined, percent)
    joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    result = _looked_up(members, joined.withColumnRenamed("node", "rep"), ["rep"])
    component = F.coalesce("component", "rep", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
