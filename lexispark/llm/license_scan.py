"""Finding of licence notices by diagonal voting.

Every run of ``K`` words of every document, and of fewer for templates so short
that no such run need survive, is hashed and joined in Spark with the positions
of the same runs in the licence templates. A match at document
word p and template word q votes for the diagonal p - q. Votes are added up by
document, template and diagonal; neighbouring diagonals, which a few inserted
or missing words cause, are merged; and the span they mark is verified by
aligning its words with the template's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, byte_view, check_names, grams_of, sendable, stored, words_of

K = 3
#: Diagonals so near to each other belong to one occurrence.
SLACK = 4
#: Share of a template's words that an occurrence must show in order.
COVERAGE = 0.75

TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def templates(spark: SparkSession) -> DataFrame:
    """The licences known by default: (license, text)."""
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")


def word_hashes(text: str) -> np.ndarray:
    return words_of(*byte_view(pa.array([text])))[0]


def common_words(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence of two word lists, with the first
    and the last word of ``b`` that it uses; the shortest such stretch's end."""
    if not len(a) or not len(b):
        return 0, 0, -1
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        # cells of a row: a match adds one to the diagonal, then the running maximum
        row = np.where(b == a[i], table[i, :-1] + 1, table[i, 1:])
        np.maximum.accumulate(row, out=row)
        table[i + 1, 1:] = row
    best = int(table[-1, -1])
    j = int(np.argmax(table[-1] == best))
    i, last = len(a), j - 1
    first = last
    while i and j and table[i, j]:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            first = j
    return best, first, last


def occurrence(want: np.ndarray, own: np.ndarray) -> tuple[int, int, int]:
    """``common_words`` of a template and a stretch of any length: one much longer than the
    template is searched in windows that overlap by half, and the first best counts."""
    size = 2 * len(want)
    if len(own) <= 2 * size:
        return common_words(want, own)
    best = (0, 0, -1)
    for at in range(0, len(own), len(want)):
        same, a, b = common_words(want, own[at : at + size])
        if same > best[0]:
            best = same, at + a, at + b
    return best


def run_length(words: int, k: int, coverage: float) -> int:
    """The longest run, of ``k`` words at most, of which one survives in an occurrence of
    the least coverage with one word put in."""
    missing = words - int(np.ceil(coverage * words))
    while k > 1 and words - k + 1 - k * missing - (k - 1) < 1:
        k -= 1
    return k


def rolling_grams(docs: DataFrame, ks: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, t, k, p, h): the hash of every run of each of ``ks`` words, with its first
    word's number; ``t`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4000):
            words, _, _, before = words_of(*byte_view(batch.column(2)))
            for k in ks:
                g, at = grams_of(words, before, k)
                of = np.searchsorted(before, at, side="right") - 1
                p = (at - before[of]).astype(np.int32)
                for i in range(0, len(g), 100_000):
                    row = pa.array(of[i : i + 100_000])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.full(len(row), k, np.int32)), pa.array(p[i : i + 100_000]), pa.array(g[i : i + 100_000].view(np.int64))],
                        names=["id", "t", "k", "p", "h"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, t long, k int, p int, h long")


def scan(docs: DataFrame, known: DataFrame | None = None, k: int = K, slack: int = SLACK, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start_word, end_word, coverage, votes): each occurrence.

    Words count from 0, ``end_word`` is the word after the last. ``coverage`` is
    the share of the template's words that the span shows in the template's
    order, at least the parameter of that name; ``votes`` counts the matching
    runs. Of occurrences of several templates that overlap all are listed. An
    occurrence must hold one run of ``k`` of the template's words whole, or, of a
    short template, one of ``run_length`` words. Null templates and those without
    words are skipped, and two templates of one name count as two.

    Null and empty texts hold nothing. Repeated rows (same id and text) count
    once; texts that share an id, null included, are scanned apart and listed
    under it. Other columns are not used. An empty table gives no rows.
    """
    check_names(id_col, "license", "start_word", "end_word", "coverage", "votes")
    spark = docs.sparkSession
    known = templates(spark) if known is None else known
    rows = sorted({(r[0], r[1]) for r in known.select("license", "text").collect() if r[0] is not None and r[1]})
    rows = [r for r in rows if len(word_hashes(r[1]))]
    hashed = [word_hashes(t) for _, t in rows]
    runs = [run_length(len(h), k, coverage) for h in hashed]
    places = []
    for n, (h, length) in enumerate(zip(hashed, runs)):
        g, at = grams_of(h, np.array([0, len(h)]), length)
        places += [(int(x), length, n, int(q)) for x, q in zip(g.view(np.int64), at)]
    index = sendable(spark.createDataFrame(places, "h long, k int, n int, q int"))
    hits = rolling_grams(docs, sorted(set(runs)) or [k], id_col, text_col).join(index, ["h", "k"]).select("id", "t", "n", "p", (F.col("p") - F.col("q")).alias("d")).distinct()
    lines = hits.groupBy("id", "t", "n", "d").agg(F.count(F.lit(1)).alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"))
    by_line = Window.partitionBy("id", "t", "n").orderBy("d")
    apart = F.col("d") - F.lag("d").over(by_line) > slack
    merged = (
        lines.withColumn("o", F.coalesce(apart.cast("int"), F.lit(0)))
        .withColumn("o", F.sum("o").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "t", "n", "o")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    # the fewest runs that a span of the least coverage can match: each missing word breaks k of them
    sizes = [len(h) for h in hashed]
    least = [max(1, m - r + 1 - r * (m - int(np.ceil(coverage * m)))) for m, r in zip(sizes, runs)]

    def of_template(values: list[int]):
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("n") + 1) if values else F.lit(1)

    found = merged.where(F.col("votes") >= of_template(least)).withColumn("end", F.col("last") + of_template(runs))
    found = stored(found, "spans")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    side = found.groupBy("id", "t").agg(F.collect_list(F.struct("n", "first", "end", "votes")).alias("spans"))
    side = sendable(side, F.size("spans").cast("long") * 40)
    both = texts.alias("a").join(side.alias("b"), (F.col("a.t") == F.col("b.t")) & F.col("a.id").eqNullSafe(F.col("b.id"))).select("a.id", "a.t", "text", "spans")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2000):
            h, _, _, before = words_of(*byte_view(batch.column(2)))
            out = []
            for i, spans in enumerate(batch.column(3).to_pylist()):
                own = h[before[i] : before[i + 1]]
                for s in spans:
                    want = hashed[s["n"]]
                    # the words around the votes may belong to the notice too
                    lo = max(0, s["first"] - len(want))
                    part = own[lo : s["end"] + len(want)]
                    same, a, b = occurrence(want, part[s["first"] - lo : s["end"] - lo])
                    a, b = a + s["first"] - lo, b + s["first"] - lo
                    if same < len(want):
                        wide, c, d = occurrence(want, part)
                        if wide > same and d - c < 1.5 * len(want):
                            same, a, b = wide, c, d
                    if same >= coverage * len(want):
                        out.append((i, s["n"], lo + a, lo + b + 1, same / len(want), s["votes"]))
            if out:
                i, n, a, b, c, v = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array([rows[x][0] for x in n]), pa.array(n, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.float64()), pa.array(v, pa.int32())],
                    names=["id", "t", "license", "n", "start_word", "end_word", "coverage", "votes"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    checked = both.mapInArrow(verify, f"id {kind}, t long, license string, n int, start_word int, end_word int, coverage double, votes int")
    return checked.distinct().select(F.col("id").alias(id_col), "license", "start_word", "end_word", "coverage", "votes")
