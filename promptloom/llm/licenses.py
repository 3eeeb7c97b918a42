"""License scans by diagonal voting.

Fixed phrases are counted where their words stand. Beside them, all rolling
word k-gram hashes of all texts are joined to the positions of the same hashes in
a fixed set of license notices. A hit votes for the diagonal (place in the text
less place in the notice); votes are summed per diagonal, diagonals that lie near
each other are merged, and a merged span is verified word by word: the longest
common subsequence with the notice must cover enough of both.

The notices are fixed and small, so they may be broadcast. Votes are aggregated
before they are shuffled. Texts with spans to verify are joined back by id and
hash of the text.

Defined cases: a null text is an empty one; words are lower-cased in A-Z only;
texts shorter than a k-gram have no votes; a text of any length counts in whole;
a repeated row gives a row each, with the label of a single one; of spans of one label that tie all count; an empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, stage

K = 3
# Diagonals at most so far apart are merged.
APART = 4
# Share of a notice's k-grams that votes must reach before its span is verified.
VOTES = 0.4
# Share of the notice and of the span that the common words must cover.
OF_NOTICE, OF_SPAN = 0.75, 0.6
BLOCK = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)

PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices as they are published, by label: short references, grants, and the paragraphs that
# follow them, each for itself, so that a text with any one of them is found. Fixed texts.
NOTICES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at",
    ),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software",
    ),
    (
        "mit",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE",
    ),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See "
        "the License for the specific language governing permissions and limitations under the License",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details",
    ),
    (
        "lgpl",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution",
    ),
    (
        "bsd",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ),
    (
        "isc",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
    ),
)

# Everything that isn't a digit, a letter or beyond ASCII separates words; A-Z become a-z.
CLEAN = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(CLEAN).split()


def phrase_places(line: bytes) -> list[tuple[int, str]]:
    """(word number, label) of each place of a phrase in single-spaced words with a space around."""
    hits = []
    for phrase, label in PHRASES:
        mark = b" " + phrase.encode() + b" "
        if mark in line:
            hits += [(m.start(), label) for m in re.finditer(b"(?=" + mark + b")", line)]
    if not hits:
        return []
    # A word's number is the number of spaces before the one it follows.
    spaces = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20)
    return [(int(np.searchsorted(spaces, at)), label) for at, label in hits]


def _base_row(text: str | None) -> tuple:
    words = words_of(text)
    places = phrase_places(b" " + b" ".join(words) + b" ")
    starts = [p for p, _ in places]
    labels = sorted({label for _, label in places})
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def base_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_base, first_word, last_word, base) of (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_base_row(t.as_py()) for t in batch.column(2)]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns],
                names=["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base"],
            )
        give_back()

    schema = "doc_id long, text_hash long, n_words long, n_base long, first_word long, last_word long, base array<string>"
    return docs.mapInArrow(run, schema)


def gram_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the hashes of its rolling k-grams."""
    lines = pa.array([(t or "").encode().translate(CLEAN) for t in texts], pa.large_binary()).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(lines)
    words = lists.flatten()
    # Leading and trailing white space leave empty strings.
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = words.dictionary_encode()
    one = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    hashes = one[coded.indices.to_numpy()[full]] if len(one) else np.zeros(0, dtype=np.uint64)
    n = max(0, len(hashes) - K + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(K):
        rolled = rolled * MIX + hashes[i : i + n]
    return [rolled[a : max(a, b - K + 1)].view(np.int64) for a, b in zip(bounds, bounds[1:], strict=False)]


def grams(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, row, hashes): the k-gram hashes of each row in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes, at = np.cumsum([len(t or "") for t in texts]), 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK)))
                found = gram_hashes(texts[at:end])
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                values = pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                own = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3), lists], names=["doc_id", "text_hash", "row", "hashes"])
                at = end
        give_back()

    numbered = docs.select("doc_id", "text_hash", "text", F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(run, "doc_id long, text_hash long, row long, hashes array<long>")


def notice_positions(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """(hash, notice, place, n): each k-gram of each notice."""
    rows = [
        (int(h), number, place, len(found))
        for number, found in enumerate(gram_hashes([text for _, text in notices]))
        for place, h in enumerate(found.tolist())
    ]
    return docs.sparkSession.createDataFrame(rows, "hash long, notice int, place int, n int")


def voted_spans(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """(doc_id, text_hash, notice, low, high): merged diagonals with enough votes, to be verified."""
    hits = (
        grams(docs)
        .select("doc_id", "text_hash", "row", F.posexplode("hashes").alias("at", "hash"))
        # The notices are a fixed table of a few hundred k-grams.
        .join(F.broadcast(notice_positions(docs, notices)), "hash")
    )
    # Each row votes for itself; what repeated rows give alike is one span in the end.
    own = ["doc_id", "text_hash", "row", "notice"]
    votes = hits.groupBy(*own, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.first("n").alias("n"))
    by_notice = Window.partitionBy(*own).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_notice) > APART, F.lit(True))
    merged = (
        votes.withColumn("new", apart.cast("int"))
        .withColumn("group", F.sum("new").over(by_notice))
        .groupBy(*own, "group")
        .agg(F.sum("votes").alias("votes"), F.first("n").alias("n"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    )
    return merged.where(F.col("votes") >= F.greatest(F.lit(1), VOTES * F.col("n"))).select(
        "doc_id", "text_hash", "notice", "low", "high"
    )


def common_words(notice: list[bytes], span: list[bytes]) -> int:
    """Length of the longest common subsequence, by one machine integer per notice word."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(notice):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(notice)) - 1
    open_bits = full
    for w in span:
        met = open_bits & where.get(w, 0)
        open_bits = (open_bits + met | open_bits & ~met) & full
    return len(notice) - open_bits.bit_count()


def best_fits(fits: list[tuple]) -> list[tuple]:
    """Of (score, start, end, notice), those that no better fit overlaps; equals stay together."""
    kept: list[tuple] = []
    for fit in sorted(fits, key=lambda f: (-f[0], *f[1:])):
        if not any(k[0] > fit[0] and k[1] < fit[2] and fit[1] < k[2] for k in kept):
            kept.append(fit)
    return kept


def verified(docs: DataFrame, spans: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """(doc_id, text_hash, notice, start, end, score) of spans whose words match their notice."""
    cut = [words_of(text) for _, text in notices]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_hash, text, asked in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, fits = words_of(text), []
                for one in asked:
                    notice = cut[one["notice"]]
                    start = max(0, one["low"])
                    span = words[start : one["high"] + len(notice)]
                    same = common_words(notice, span)
                    if same >= OF_NOTICE * len(notice) and same >= OF_SPAN * len(span):
                        score = 2 * same / (len(notice) + len(span))
                        fits.append((score, start, start + len(span), one["notice"]))
                rows += [(doc, text_hash, notice, start, end, score) for score, start, end, notice in best_fits(fits)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "text_hash", "notice", "start", "end", "score"],
            )
        give_back()

    asked = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("notice", "low", "high")).alias("asked"))
    texts = docs.alias("d").join(
        asked.alias("a"), F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.text_hash") == F.col("a.text_hash"))
    )
    return texts.select("d.doc_id", "d.text_hash", "d.text", "a.asked").mapInArrow(
        run, "doc_id long, text_hash long, notice int, start long, end long, score double"
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """(doc_id, text_hash, n_words, n_base, first_word, last_word, base, found, score) of every row.

    ``found``: distinct (label, start, end, score) of verified spans.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    spans = stage(voted_spans(narrow, notices), "spans")
    labels = F.array(*[F.lit(label) for label, _ in notices])
    one = F.struct(F.get(labels, F.col("notice")).alias("label"), "start", "end", "score")
    found = verified(narrow, spans, notices).groupBy("doc_id", "text_hash").agg(F.collect_set(one).alias("found"))
    base = base_scan(narrow)
    joined = base.alias("b").join(
        found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.text_hash") == F.col("f.text_hash")), "left"
    )
    none = F.array().cast("array<struct<label:string,start:long,end:long,score:double>>")
    return joined.select(
        "b.doc_id",
        "b.text_hash",
        *["n_words", "n_base", "first_word", "last_word", "base"],
        F.coalesce("found", none).alias("found"),
        F.greatest(
            F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)),
            F.when(F.col("n_base") > 0, 0.5).otherwise(0.0),
        ).alias("score"),
    )
