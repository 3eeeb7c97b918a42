"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into two halves of sixteen 2-bit segments; each
half maps to the vector of its segments' bit counts. Flipping one bit moves one
count by one, so the Manhattan distance of two vectors never exceeds the Hamming
distance of the fingerprints. With at most ``radius`` differing bits, one half
differs in at most ``radius // 2``, so the range join over the grid of count
vectors looks at equal cells and at cells one step away, keeps what the whole
embedding's Manhattan distance allows, and verifies by counting differing bits.

Equal fingerprints are one row before any of that. A cell that holds more than
``CELL`` residents is split by further segments: of the other half's two quarters one
differs in at most ``radius // 2`` again. What is still too full isn't expanded into
pairs: two fingerprints differ in at most two bits exactly if some 64-bit value lies
within one bit of both, so members of such cells meet at these values, 65 rows each,
with the same links in the end.

Defined cases: a null, empty or blank text has fingerprint zero, which links
like any other; texts under ``k`` words are one shingle; repeated shingles
count as often as they occur; a tie of a bit is 0; repeated rows of one id
give one row each; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, stage
from .components import connected_components

# Residents of a grid cell up to which its pairs are looked at one by one.
CELL = 64
# Shingles whose bits are counted at a time.
BLOCK = 1 << 15
LOW = 0xFFFFFFFF
# The low bit of each 2-bit segment.
LOW_BITS = 0x5555555555555555


def fingerprint(text: str | None, k: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    size = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = zip(starts[at : min(at + BLOCK, n)], ends[at + size - 1 : min(at + BLOCK, n) + size - 1], strict=True)
        hashes = np.array([digest(line[a : b - 1], 42) for a, b in part], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp: long, the fingerprint's bits, text_hash) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], dtype=np.uint64)
            columns = [batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "text_hash"])
        give_back()

    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return narrow.mapInArrow(run, "id long, fp long, text_hash long")


def segment_counts(fp: Column) -> Column:
    """The ones of each 2-bit segment moved to its low end: 0, 1 or 2 as 00, 01 or 11.

    In this form the Manhattan distance of two count vectors is the number of
    bits in which they differ.
    """
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(LOW_BITS))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def _cell(h: int, half: Column) -> Column:
    return F.shiftleft(half, 1).bitwiseOR(F.lit(h).cast("long"))


def _step(half: Column, j: int) -> Column:
    """``half`` with one more in segment ``j``, or null where that is full."""
    low, full = F.lit(1 << (2 * j)).cast("long"), F.lit(2 << (2 * j)).cast("long")
    more = half.bitwiseOR(low).bitwiseOR(F.shiftleft(half.bitwiseAND(low), 1))
    return F.when(half.bitwiseAND(full) == 0, more)


def _back(part: Column, j: int) -> Column:
    """``part`` with one less in segment ``j``, or null where that is empty."""
    low, full = F.lit(1 << (2 * j)).cast("long"), F.lit(2 << (2 * j)).cast("long")
    less = F.when(part.bitwiseAND(full) != 0, part.bitwiseXOR(full)).otherwise(part.bitwiseXOR(low))
    return F.when(part.bitwiseAND(low) != 0, less)


def _quarters(counts: Column, cell: Column) -> list[Column]:
    """The two quarters of the half that ``cell`` isn't about."""
    other = F.when(cell.bitwiseAND(F.lit(1)) == 0, F.shiftrightunsigned(counts, 32)).otherwise(counts.bitwiseAND(F.lit(LOW)))
    return [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)]


def _finer(cell: Column, q: int, quarter: Column) -> Column:
    return F.shiftleft(cell, 17).bitwiseOR(F.shiftleft(quarter, 1)).bitwiseOR(F.lit(q).cast("long"))


def _near(looks: DataFrame, residents: DataFrame, radius: int) -> DataFrame:
    """Pairs (src, dst) of one cell whose embeddings and then fingerprints are within ``radius``."""
    held = residents.select("cell", F.col("fp").alias("dst"), F.col("counts").alias("dst_counts"))
    return (
        looks.join(held, "cell")
        .where((F.col("src") != F.col("dst")) & (distance(F.col("src_counts"), F.col("dst_counts")) <= radius))
        .where(distance(F.col("src"), F.col("dst")) <= radius)
        .select("src", "dst")
    )


def _full(residents: DataFrame, cell: int) -> DataFrame:
    """The cells of more than ``cell`` residents; staged, so that no branch counts them again and few of them need no shuffle."""
    return stage(residents.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("cell"), "full")


def fingerprint_links(prints: DataFrame, radius: int = 2, cell: int = CELL) -> DataFrame:
    """Distinct ``fp`` -> links (src, dst) whose components are those of all pairs within ``radius``.

    In cells of at most ``cell`` residents these are all the pairs, in fuller ones all
    the pairs of their finer cells; where those are full too, stars through common
    neighbours.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    whole = prints.select("fp", segment_counts(F.col("fp")).alias("counts"))
    halves = whole.select(
        "fp",
        "counts",
        F.col("counts").bitwiseAND(F.lit(LOW)).alias("half0"),
        F.shiftrightunsigned("counts", 32).alias("half1"),
    )
    own = [_cell(h, F.col(f"half{h}")) for h in (0, 1)]
    residents = halves.select("fp", "counts", F.explode(F.array(*own)).alias("cell"))
    steps = [_cell(h, _step(F.col(f"half{h}"), j)) for h in (0, 1) for j in range(16)] if radius == 2 else []
    looks = halves.select(
        F.col("fp").alias("src"),
        F.col("counts").alias("src_counts"),
        F.explode(F.array_compact(F.array(*own, *steps))).alias("cell"),
    )
    full = _full(residents, cell)
    near = _near(looks, residents.join(full, "cell", "left_anti"), radius)
    # The same once more in the full cells, by a quarter of the other half.
    inside = residents.join(full, "cell", "left_semi")
    finer = [_finer(F.col("cell"), q, part) for q, part in enumerate(_quarters(F.col("counts"), F.col("cell")))]
    residents = inside.select("fp", "counts", F.explode(F.array(*finer)).alias("cell"))
    finer = []
    for q, part in enumerate(_quarters(F.col("src_counts"), F.col("cell"))):
        moved = [m for j in range(8) for m in (_step(part, j), _back(part, j))] if radius == 2 else []
        finer += [_finer(F.col("cell"), q, p) for p in (part, *moved)]
    looks = looks.join(full, "cell", "left_semi").select("src", "src_counts", F.explode(F.array_compact(F.array(*finer))).alias("cell"))
    full = _full(residents, cell)
    near = near.union(_near(looks, residents.join(full, "cell", "left_anti"), radius))
    crowded = looks.join(full, "cell", "left_semi").select(F.col("src").alias("fp")).distinct()
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), j)) for j in range(64)]
    meets = crowded.select("fp", F.explode(F.array(*around)).alias("at"))
    least = meets.groupBy("at").agg(F.min("fp").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = (
        meets.join(least, "at")
        .where((F.col("fp") != F.col("dst")) & (distance(F.col("fp"), F.col("dst")) <= radius))
        .select(F.col("fp").alias("src"), "dst")
    )
    return near.union(stars)


def _firsts(prints: DataFrame, radius: int) -> DataFrame:
    """Staged (fp, first): the component's least (id, text_hash), for each fingerprint."""
    row = F.when(F.col("id").isNotNull(), F.struct("id", "text_hash"))
    classes = stage(prints.groupBy("fp").agg(F.min(row).alias("least")), "classes")
    found = connected_components(fingerprint_links(classes.select("fp"), radius))
    # The least document of a component, over the least of each of its fingerprints.
    linked = found.withColumnsRenamed({"id": "fp", "component_id": "root"}).join(classes, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("first"))
    moved = linked.join(least, "root").select("fp", "first")
    named = classes.join(moved, "fp", "left").select("fp", F.coalesce("first", "least").alias("first"))
    # Staged, so that both sides of a later join are shuffled and a hot fingerprint can be split.
    return stage(named, "named")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component_id): one row per row of ``docs``."""
    prints = stage(fingerprints(docs, id_col, text_col, k), "simhash")
    named = _firsts(prints, radius).select("fp", F.col("first.id").alias("component_id"))
    return prints.join(named, "fp").select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """The row with the least (id, hash of the text) of each component, with all columns of ``docs``.

    Rows of one id whose texts are in different components each stand for their
    own. Rows repeated with id and text count once: the first in the order of
    their other columns' hash stays. Rows whose id is null are kept, for they
    name no group.
    """
    named = docs.where(F.col(id_col).isNotNull())
    keep = _firsts(stage(fingerprints(named, id_col, text_col, k), "simhash"), radius).select("first").distinct()
    own = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind]
    rows = named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), own.alias("first"), F.xxhash64(F.lit(0), *others).alias("__order"))
    kept = rows.join(keep, "first", "left_semi").groupBy("first").agg(F.min_by("__row", "__order").alias("__row"))
    return kept.select("__row.*").unionByName(docs.where(F.col(id_col).isNull()))
