"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: runs of three characters by class, hashed words, how far back a
word was last said, the lengths of words, lines and repeated lines. Each family of terms
is a distribution, of which square roots are taken, so long and short texts of a kind are
alike. Terms are weighted by how few documents hold them (counted over all documents); a
singular value decomposition of labelled texts (at most ``ROWS`` of each label, by a hash
of the id) gives ``RANK`` latent directions. The labelled texts' vectors are broadcast.

Every document is mapped to the same space; its cosines with all labelled vectors are
worked out block by block, exactly, and the ``NEIGHBOURS`` nearest ones vote with their
label, weighted by a power of their similarity and by how many labelled rows each stands
for. All that tie with the last one vote too, so the order of rows doesn't matter.

Memory is bounded: a block of documents holds at most ``BLOCK_BYTES`` of text (or one
text) and ``BLOCK_ROWS`` rows; the model has at most twice ``ROWS`` vectors.

Defined cases: a null, empty or blank text has the one term that it has no words, and so
is nearest to labelled texts of its kind; texts of any length go in whole; a text that is
similar to no labelled one has the share of good labels as its score; labels given twice
count as good only if all say so; null labels and ids are left out; without labels every
score is 0; repeated rows give a row each; a null id is in no part, so its ``held_out``
is null; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

# Labelled texts of each kind that the space is fitted on, at most.
ROWS = 1500
RANK = 48
NEIGHBOURS = 15
POWER = 16
THRESHOLD = 0.7
BLOCK_BYTES, BLOCK_ROWS = 4_000_000, 1024

# Classes of bytes for runs of characters. Fixed values.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:", "!?", "\"'()[]{}", "#*$%&|<>", "-_/\\=+@~^`")
OTHER, WIDE = len(CLASSES), len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
WORDS, BACK, LENGTHS, LINES = 256, 16, 24, 12
FAMILIES = (N_CLASSES**3, WORDS, BACK, LENGTHS, LINES, 4, 1)
TERMS = sum(FAMILIES)
STARTS = np.concatenate([[0], np.cumsum(FAMILIES)])[:-1]
# Of each family, how much it weighs beside the others.
WEIGHTS = (1.0, 0.3, 1.0, 0.5, 0.5, 1.0, 1.0)
ODD = np.uint64(0x9E3779B97F4A7C15)


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.int64)
    table[128:] = WIDE
    for i, some in enumerate(CLASSES):
        table[np.frombuffer(some.encode(), dtype=np.uint8)] = i
    return table


CLASS = _class_table()
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(n: int) -> np.ndarray:
    out = np.full(n, ODD)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: a polynomial, by running sums."""
    with np.errstate(over="ignore"):
        forward = _powers(len(raw) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * forward[:-1])])
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        back = np.full(len(raw) + 1, inverse)
        back[:1] = 1
        back = np.multiply.accumulate(back)
        mixed = (sums[ends] - sums[starts]) * back[starts] * np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(32))


def _last_said(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many places back in its text the same key stands; 0 where it is new."""
    order = np.lexsort((keys, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    out = np.zeros(len(keys), dtype=np.int64)
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def _bucket(values: np.ndarray, most: int) -> np.ndarray:
    """0 for 0, else one more than the floor of the binary logarithm, at most ``most - 1``."""
    return np.minimum(np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0), most - 1)


def term_counts(texts: list[bytes]) -> np.ndarray:
    """(texts, TERMS) counts."""
    n = len(texts)
    raw = np.frombuffer(b"\n\n".join([*texts, b""]), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(n), lengths + 2)
    starts = np.cumsum(lengths + 2) - lengths - 2
    inside = np.arange(len(raw)) - starts[owner] < lengths[owner]
    counts = np.zeros((n, TERMS), dtype=np.float32)

    def add(family: int, who: np.ndarray, what: np.ndarray) -> None:
        size = FAMILIES[family]
        counts[:, STARTS[family] : STARTS[family] + size] += np.bincount(who * size + what, minlength=n * size).reshape(n, size)

    kinds = CLASS[raw]
    runs = (kinds[:-2] * N_CLASSES + kinds[1:-1]) * N_CLASSES + kinds[2:]
    # A run counts where it begins; at a text's end it takes in the line breaks after it.
    add(0, owner[:-2][inside[:-2]], runs[inside[:-2]])
    lower = LOWER[raw]
    begin, end = _spans(~SPACES[raw] & inside)
    who, words = owner[begin], _hashes(lower, begin, end)
    add(1, who, (words % np.uint64(WORDS)).astype(np.int64))
    add(2, who, _bucket(_last_said(who, words), BACK))
    add(3, who, np.minimum(end - begin, LENGTHS - 1))
    first, last = _spans((raw != 10) & inside)
    of_line, lines = owner[first], _hashes(lower, first, last)
    add(4, of_line, _bucket(last - first, LINES))
    add(5, of_line, _bucket(_last_said(of_line, lines), 4))
    counts[:, STARTS[6]] = np.bincount(who, minlength=n) == 0
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of each family's shares, by the rarity of terms, of length 1."""
    out = np.sqrt(counts)
    for start, size, weight in zip(STARTS, FAMILIES, WEIGHTS, strict=True):
        part = out[:, start : start + size]
        part *= weight / np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1.0)
    out *= idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    """Whole texts, so many at a time as fit a block."""
    own, size = [], 0
    for t in texts:
        raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
        if own and (size + len(raw) > BLOCK_BYTES or len(own) >= BLOCK_ROWS):
            yield own
            own, size = [], 0
        own.append(raw)
        size += len(raw)
    if own:
        yield own


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The number of documents, then of those that hold each term; of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for some in blocks(batch.column(0)):
                total[0] += len(some)
                total[1:] += (term_counts(some) > 0).sum(0)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(total)], names=["term", "n"])

    text = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    out = np.zeros(TERMS + 1, dtype=np.int64)
    for r in text.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def held_out(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term counts, labels (1 good) and weights of labelled texts outside the held-out part, at most ``rows`` ids of each label.

    An id with several texts gives the one whose hash is least. What comes to the driver
    is term counts, of one size for texts of any length.
    """
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") == 1).cast("int").alias("good"))
    )
    totals = {r["good"]: r["n"] for r in one.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    some = one.where("good = 1").orderBy(*order).limit(rows).union(one.where("good = 0").orderBy(*order).limit(rows))
    # At most twice ``rows`` ids.
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    texts = held.groupBy("doc_id", "good").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in blocks(batch.column(2)):
                found, own = term_counts(block), batch.slice(at, len(block))
                at += len(block)
                terms = [np.flatnonzero(f) for f in found]
                lists = [pa.array(terms, pa.list_(pa.int32())), pa.array([f[t] for f, t in zip(found, terms, strict=True)], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *lists], names=["doc_id", "good", "terms", "counts"])

    found = texts.mapInArrow(run, "doc_id long, good int, terms array<int>, counts array<float>").toArrow()
    ids, good = found.column("doc_id").to_pylist(), np.array(found.column("good").to_pylist(), dtype=np.float64)
    counts = np.zeros((len(ids), TERMS), dtype=np.float32)
    for row, terms, values in zip(counts, found.column("terms"), found.column("counts"), strict=True):
        row[terms.values.to_numpy()] = values.values.to_numpy()
    by = sorted(range(len(ids)), key=lambda i: (zlib.crc32(b"%d" % ids[i]), ids[i]))
    stands = np.array([totals.get(k, 0) / max(1, min(rows, totals.get(k, 0))) for k in (0, 1)])
    return counts[by], good[by], stands[good.astype(int)][by]


class Model:
    """The latent space, and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, good: np.ndarray, stands: np.ndarray, frequencies: np.ndarray, rank: int = RANK):
        self.idf = np.log((1 + frequencies[0]) / (1 + frequencies[1:])).astype(np.float32) + 1
        x = weighted(counts, self.idf).astype(np.float32)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.project = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
        self.vectors, self.good, self.stands = self.place(counts), good, stands

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Latent vectors of length 1; zero where a text has no part in the space."""
        found = weighted(counts, self.idf) @ self.project
        length = np.linalg.norm(found, axis=1, keepdims=True)
        return np.where(length > 1e-6, found / np.maximum(length, 1e-12), 0).astype(np.float32)

    def score(self, texts: list[bytes], neighbours: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
        if not len(self.good):
            return np.zeros(len(texts))
        # Rounded, so that equal texts tie in any block.
        near = np.round(self.place(term_counts(texts)) @ self.vectors.T, 5)
        k = min(neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        vote = np.where((near >= last[:, None]) & (near > 0), near, 0.0).astype(np.float64) ** power * self.stands
        total = vote.sum(1)
        prior = float((self.good * self.stands).sum() / self.stands.sum())
        return np.round(np.where(total > 0, vote @ self.good / np.maximum(total, 1e-300), prior), 6)


def quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(b) for b in blocks(batch.column(1))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])
        give_back()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    counts, good, stands = sample(docs, labels)
    return quality(docs, Model(counts, good, stands, document_frequencies(docs)))
