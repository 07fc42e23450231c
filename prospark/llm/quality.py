"""Quality rules as a bitmask ledger.

`measure` computes every measurement of a text once, `ledger` evaluates every rule once and stores the failed ones as
bits beside the measurements; `apply_policy` is one bitwise AND with a policy's mask, and `ablation` computes what each
rule of a policy does from counts per distinct bitmask, without touching the texts again. All of it is DataFrame
expressions on rows as they come: nothing is exchanged but the counts of the ablation (at most 2**rules rows a task).

Words repeated in 5-word windows: names of all windows are compared inside the row; only texts with equal names sort
the windows of those names, by their words, so names decide nothing.

Word length is judged on runs of scripts that put spaces between words: Han, Kana, Thai, Lao, Khmer and Myanmar
characters end a run and are no part of one. The SQL twin judges white-space words and differs on such texts only.

Defined cases: a null or empty text has no words and fails `few_words`; other columns may hold nulls; repeated rows are
judged one by one; an empty table gives an empty ledger. Input columns are kept in the struct `doc`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospark.llm.chunks import packed

WHITE = r" \t\n\x0B\f\r"
#: Scripts without spaces between words, with the marks and full-width forms that stand among them.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\u3000-\u303F\u30A0-\u30FF\uFF00-\uFFEF]"


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` (SQL over the measurements) is true. Bit numbers keep their meaning for good."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 25 * n_words"),
    Rule(3, "shouting", "100 * n_upper > 60 * (word_chars - n_symbols)"),
    Rule(4, "repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "long_runs", "run_chars > 20 * n_runs"),
)

#: Versioned policies: a text is kept if it fails none of the named rules. A version never changes; `v2` judges the length
#: of words on scripts that put spaces between them.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "shouting", "repeated_lines", "long_words"),
    "v2": ("few_words", "repeated_words", "symbols", "shouting", "repeated_lines", "long_runs"),
}
CURRENT = "v2"


def mask(rules: Sequence[str], known: Sequence[Rule] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in known}
    return sum(bits[name] for name in rules)


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WHITE}]+"))


def _covered(starts: Column, width: int) -> Column:
    """Places covered by windows of `width` that begin at the ascending `starts`."""
    gaps = F.transform(starts, lambda s, i: F.when(i == 0, F.lit(width)).otherwise(F.least(F.lit(width), s - F.get(starts, i - 1))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`doc` (all columns of `docs`) and the measurements of its text."""
    text = F.coalesce(F.col(f"doc.`{text_col}`").cast("string"), F.lit(""))
    rows = packed(docs).select("doc", text.alias("t")).select("doc", "t", _words(F.col("t")).alias("w"))
    word = lambda i, k: F.get(F.col("w"), i + k)
    names = F.when(
        F.size("w") >= 5,
        F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[word(i, k) for k in range(5)])),
    )
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    rows = rows.select("doc", "t", "w", names.alias("g"), lines.alias("lines"))
    rows = rows.select("*", (F.size(F.array_distinct("g")) < F.size("g")).alias("again"))
    same = lambda xs, x, i, f: (f(x) == f(F.get(xs, i - 1))) | (f(x) == f(F.get(xs, i + 1)))
    twice = lambda xs, f: F.filter(xs, lambda x, i: F.coalesce(same(xs, x, i, f), F.lit(False)))
    by_name = F.sort_array(F.transform("g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.select("doc", "t", "w", "lines", F.when(F.col("again"), by_name).alias("s"))
    rows = rows.select("doc", "t", "w", "lines", twice(F.col("s"), lambda x: x["g"]).alias("s"))
    text_of = lambda x: F.struct(F.slice(F.col("w"), x["i"] + 1, F.lit(5)).alias("g"), x["i"].alias("i"))
    rows = rows.select("doc", "t", "w", "lines", F.sort_array(F.transform("s", text_of)).alias("s"))
    starts = F.sort_array(F.transform(twice(F.col("s"), lambda x: x["g"]), lambda x: x["i"]))
    unspaced = (F.octet_length("t") > F.length("t")) & F.col("t").rlike(UNSPACED)
    runs = F.when(unspaced, _words(F.regexp_replace("t", f"{UNSPACED}+", " ")))
    rows = rows.select("doc", "t", "w", "lines", starts.alias("s"), runs.alias("runs"))
    runs = F.coalesce("runs", "w")
    without = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    measures = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(runs).cast("long").alias("n_runs"),
        F.length(F.array_join(runs, "")).cast("long").alias("run_chars"),
        without(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        without(r"\p{Lu}+").cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("s"), 5), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # A generator of one row: a filter on a measurement stays above it, else it would be rewritten into a filter on the
    # text with every step above inlined several times.
    return rows.select("doc", F.inline(F.array(measures)))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """`doc`, the measurements and `fail_bits`: bit b is set where the rule of that bit fails."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text_col).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, rules: Sequence[str], known: Sequence[Rule] = RULES) -> Column:
    """True for the rows of a ledger that a policy keeps."""
    return book["fail_bits"].bitwiseAND(F.lit(mask(rules, known))) == 0


def ablation(book: DataFrame, rules: Sequence[str], known: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of a policy: texts that fail it, that only it rejects, and that stay without it."""
    whole = mask(rules, known)
    counts = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in known if r.name in rules])
    failed = F.col("fail_bits").bitwiseAND(F.lit(whole))
    where = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        counts.select(failed.alias("failed"), "n", F.explode(each).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            where(F.col("failed").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            where(F.col("failed") == F.col("r.bit")).alias("n_only"),
            where(F.col("failed").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
        )
    )
