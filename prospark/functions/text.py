"""Text rules of evidence checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospark import rules
from prospark.functions.urls import let

# The characters that count as white space.
_BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
_BLANKS += "\u2028\u2029\u202f\u205f\u3000"
_MARKS = rules.QUOTE_PUNCTUATION[1:-1]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def plain_words(text: Column) -> Column:
    """Lower case, punctuation and white space reduced to single blanks."""
    spaced = F.regexp_replace(F.lower(text), rules.QUOTE_PUNCTUATION, " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def mark_runs(text: Column) -> Column:
    """All distinct runs of punctuation and blanks that start with a mark, joined into one text.

    A quote without any word can only occur inside such a run.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)[{_MARKS}][\s{_MARKS}]*"), F.lit(0))
    return F.array_join(F.array_distinct(runs), "\x01")


def page_words(title: Column, content: Column, metadata: Column) -> Column:
    """The searched text of a page: title, body and metadata."""
    parts = [F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")), F.coalesce(metadata, F.lit(""))]
    return F.concat_ws(" ", *parts)


def quote_parts(evidence: Column) -> Column:
    """struct(given, bare, words, windows) of a quote, computed once on the quote side.

    `windows` are the runs of four words with at least 20 characters.
    """
    stripped = strip(F.coalesce(evidence, F.lit("")))

    def build(q: Column) -> Column:
        # A pair of equal quote marks around the text is dropped.
        wrapped = q.rlike(r"(?s)^\".*\"$|^'.*'$|^[\"']$")
        inside = strip(F.substring(q, F.lit(2), F.greatest(F.length(q) - 2, F.lit(0))))
        inner = F.when(wrapped, inside).otherwise(q)
        return F.struct((q != "").alias("given"), F.lower(inner).alias("bare"), plain_words(inner).alias("words"))

    def long_runs(words: Column) -> Column:
        starts = F.when(F.size(words) >= 4, F.sequence(F.lit(1), F.size(words) - 3)).otherwise(
            F.array().cast("array<int>")
        )
        runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(4)), " "))
        return F.array_distinct(F.filter(runs, lambda s: F.length(s) >= 20))

    def windows(p: Column) -> Column:
        long = let(F.split(p["words"], " "), long_runs)
        return F.struct(p["given"].alias("given"), p["bare"].alias("bare"), p["words"].alias("words"), long.alias("windows"))

    return let(let(stripped, build), windows)


def quote_found(quote: Column, words: Column, marks: Column) -> Column:
    """Whether a quote (from `quote_parts`) occurs on a page (from `plain_words`, `mark_runs`).

    The page holds the words in order, or any of the quote's four-word windows.
    """
    return (
        F.when(~quote["given"], False)
        .when(quote["bare"] == "", True)
        .when(quote["words"] == "", F.contains(marks, quote["bare"]))
        .otherwise(
            F.contains(words, quote["words"]) | F.exists(quote["windows"], lambda w: F.contains(words, w))
        )
    )
