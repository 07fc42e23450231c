"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined, by name and then word by word, to the k-grams of the templates. A hit
at word p on template offset o votes for diagonal p - o. A diagonal with votes for every offset is an exact place of the
template. For a match in part, neighbouring diagonals are merged: words were added or left out between them. Diagonals
are merged within bands of twice a slack, each band overlapping the next by half, so what lies within one slack is in
one band, and no chain of diagonals makes a span longer than its template and twice the slack. The slack is at least
two words and grows with the template (`DRIFT` of 100 offsets). A merged span is verified: of its hits, one for each
offset, those count that stand behind the hit of the offset before; their share of all offsets decides.

The words of a text are exploded and joined in one pass over the text; only votes and one row per text are exchanged,
by text. The template table is a parameter of at most MOST_GRAMS k-grams, so it is broadcast. Everything is DataFrame
functions.

Defined cases: a null or empty text has no words, no places and score 0; a null doc_id stays null; repeated rows are
scanned one by one; an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_GRAMS = 10_000
SLACK, DRIFT = 2, 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """`exact` templates count whole places only; the others also match in part."""

    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(SEPARATORS, self.text.lower()) if w]


BASE = (
    Template("cc-by", "cc by", exact=True),
    Template("gpl", "general public license", exact=True),
    Template("reserved", "all rights reserved", exact=True),
)
NOTICES = (
    Template("notice-gpl", "this work is licensed under the gnu general public license version 3"),
    Template("notice-cc-by-nc", "licensed under cc by nc 4 0"),
    Template("notice-apache", "licensed under the apache license version 2 0"),
    Template("notice-mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("notice-bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("notice-public-domain", "this work is dedicated to the public domain"),
)
# Whole texts and headers of common licenses.
LICENSES = (
    Template(
        "license-mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    Template(
        "license-isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
        IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    Template(
        "license-bsd-3",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY
        OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    Template(
        "header-apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    Template(
        "header-gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
)


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all other characters as they are; pure ASCII texts take the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def letter_words(text: Column) -> Column:
    """Words as runs of digits, ASCII letters and all characters beyond ASCII."""
    bare = F.regexp_replace(ascii_lower(text), "^" + SEPARATORS, "")
    parts = F.split(bare, SEPARATORS)
    return F.when(bare == "", F.array().cast("array<string>")).when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)


def slack_of(offsets: int, slack: int = SLACK) -> int:
    """Words that may be added or left out inside a template."""
    return max(slack, -(-offsets * DRIFT // 100))


def grams(spark: SparkSession, templates: Sequence[Template], k: int, slack: int = SLACK) -> DataFrame:
    """(template, label, exact, offsets, slack, offset, gram): one row for each k-gram of each template."""
    rows = []
    for t, template in enumerate(templates):
        words = template.words
        offsets = len(words) - k + 1
        if offsets < 1:
            raise ValueError(f"template {template.label!r} needs {k} words")
        rows += [(t, template.label, template.exact, offsets, slack_of(offsets, slack), o, words[o : o + k]) for o in range(offsets)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"{len(rows)} template k-grams; scan with parts of at most {MOST_GRAMS}")
    kind = T.StructType.fromDDL("template int, label string, exact boolean, offsets int, slack int, offset int, gram array<string>")
    return spark.createDataFrame(rows, kind)


def votes(docs: DataFrame, templates: Sequence[Template], k: int = 2, slack: int = SLACK) -> DataFrame:
    """Hits of all rolling k-grams, and one row without a template for each text, dealt out by `rid`."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id").alias("doc_id"),
        letter_words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"),
    )
    rows = rows.select("rid", "doc_id", "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    own = [F.col("word"), *[F.get("w", F.col("pos") + i) for i in range(1, k)]]
    known = grams(docs.sparkSession, templates, k, slack).withColumn("name", F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(k)]))
    at = (F.xxhash64(*own) == F.col("name")) & (F.col("pos") + k <= F.col("n_words"))
    for i, word in enumerate(own):
        at &= word == F.get("gram", F.lit(i))
    hits = rows.join(F.broadcast(known), at, "left")
    return (
        hits.where("template IS NOT NULL OR pos IS NULL OR pos = 0")
        .select("rid", "doc_id", "n_words", "template", "label", "exact", "offsets", "slack", "offset", "pos")
        .repartition("rid")
    )


def spans(hits: DataFrame) -> DataFrame:
    """One row per (text, template, span): whether it is exact, its first word, the share of offsets in order.

    A span is one diagonal of an exact template, else a band of diagonals. Texts without hits have one row without a
    template.
    """
    diagonal = F.col("pos") - F.col("offset")
    band = F.floor(diagonal / F.col("slack"))
    bands = F.when(F.col("exact"), F.array(diagonal.cast("long"))).when(~F.col("exact"), F.array(band, band - 1)).otherwise(F.array(F.lit(0).cast("long")))
    keys = ["rid", "doc_id", "n_words", "template", "label", "exact", "offsets", "span"]
    # Votes of the merged diagonals: the first place of each offset.
    voted = hits.withColumn("span", F.explode(bands)).groupBy(*keys, "offset").agg(F.min("pos").alias("pos"))
    lines = voted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("offset", "pos"))).alias("line"))
    before = lambda i: F.get("line", i - 1)["pos"]
    ordered = F.size(F.filter("line", lambda x, i: (i == 0) | (x["pos"] > before(i))))
    whole = F.col("exact") & (F.size("line") == F.col("offsets"))
    return lines.select(*keys, whole.alias("whole"), (ordered / F.col("offsets")).alias("share"))


def license_scan(
    docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = (*NOTICES, *LICENSES), slack: int = SLACK, least: float = 0.7
) -> DataFrame:
    """One row per text: n_words, places of the base phrases, labels of both kinds and the best share of a template.

    Base templates must stand whole; a notice is a match from a share of `least` of its k-grams on, in order.
    """
    found = spans(votes(docs, [*base, *notices], slack=slack))
    plain = F.coalesce(F.col("whole"), F.lit(False))
    match = plain | (~F.col("exact") & (F.col("share") >= least))
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    return found.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.count_if(plain).cast("long").alias("n_base"),
        F.min(F.when(plain, F.col("span"))).cast("long").alias("first_word"),
        F.max(F.when(plain, F.col("span"))).cast("long").alias("last_word"),
        labels(plain).alias("base_labels"),
        labels(match).alias("labels"),
        F.coalesce(F.max(F.when(match, F.when(plain, F.lit(1.0)).otherwise(F.col("share")))), F.lit(0.0)).alias("score"),
    )
