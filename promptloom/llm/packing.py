"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces; only a document of more than ``capacity`` tokens
is cut, and full pieces are sequences of their own. The rest, one piece a document
at most, is dealt into shards of about ``SHARD`` pieces: by a hash, or, where the
documents have an order, by windows of it. Each shard is packed by several islands,
each a small population that starts from random orders, best-fitted. Crossover injects
whole well-filled bins of one parent into another, dissolves the bins that hold the same
pieces and a share of the emptiest ones, and best-fits what that displaces, the longest
first or nearly so. After the first epoch each island sends its elite to the next one in
a ring; the second epoch starts from both; the island with the fewest bins wins its
shard. An island stops at the lower bound, or when so many crossovers in a row bring
nothing.

Memory: a task holds one shard's lengths. Reruns give the same packing for the
same staged pieces.

Defined cases: a null or empty text is one piece that holds the separator only; a null
id stays null; a text of any length is cut, never shortened; repeated rows are packed
each; ties of lengths are broken by the piece's number; an empty table gives an empty
one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, stage
from .tokens import PartTokenizer

CAPACITY = 2048
SHARD = 8192
ISLANDS = 2
POPULATION = 4
# Crossovers of an island's epoch at most, and without a gain.
CHILDREN, IDLE = 40, 12

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    place: dict[str, Column] | None = None,
) -> DataFrame:
    """The pieces of each document: its ids, then the separator id 0, cut at ``capacity``; ``place`` is kept of each."""
    place = place or {}
    kept_names = list(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PartTokenizer(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            of: list[int] = []
            for i, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), coder.ids(batch.column(1)), strict=True)):
                ids += b"\0\0\0\0"
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
                    of.append(i)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *kept_names]
            kept = [c.take(pa.array(of, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], *kept], names=names)
        del coder
        give_back()

    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *[c.cast("long").alias(k) for k, c in place.items()],
    )
    return narrow.mapInArrow(run, ", ".join([PIECES, *[f"{k} long" for k in place]]))


class Packing:
    """Bins of item numbers, with their fills."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def fitness(self, capacity: int) -> tuple[int, float]:
        fills = np.array(self.fills, dtype=float) / capacity
        return -len(self.bins), float((fills * fills).sum())


def best_fit(items: list[int], lengths: list[int], capacity: int, start: Packing | None = None) -> Packing:
    """Put each item in turn into the fullest bin that takes it, else into a new one."""
    bins = [list(b) for b in start.bins] if start else []
    fills = list(start.fills) if start else []
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bits = 0
    for b, fill in enumerate(fills):
        if free := capacity - fill:
            spaces[free].append(b)
            open_bits |= 1 << free
    for item in items:
        size = lengths[item]
        if fits := open_bits >> size:
            free = size + (fits & -fits).bit_length() - 1
            b = spaces[free].pop()
            if not spaces[free]:
                open_bits ^= 1 << free
            bins[b].append(item)
            fills[b] += size
        else:
            b, free = len(bins), capacity
            bins.append([item])
            fills.append(size)
        if left := free - size:
            spaces[left].append(b)
            open_bits |= 1 << left
    return Packing(bins, fills)


def _without(parent: Packing, dissolved: np.ndarray, kept_out: set[int]) -> tuple[Packing, list[int]]:
    """``parent`` without the dissolved bins, and their items except ``kept_out``."""
    bins, fills, loose = [], [], []
    for b, gone in enumerate(dissolved.tolist()):
        if gone:
            loose += [i for i in parent.bins[b] if i not in kept_out]
        else:
            bins.append(parent.bins[b])
            fills.append(parent.fills[b])
    return Packing(bins, fills), loose


def crossover(a: Packing, b: Packing, lengths: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """A child of ``a`` that holds whole well-filled bins of ``b``."""
    fills = np.array(b.fills)
    good = np.flatnonzero(fills >= np.quantile(fills, 0.5))
    picked = good[rng.random(len(good)) < 0.2 * rng.random()]
    if not len(picked):
        picked = rng.choice(good, size=1)
    injected = {i for p in picked for i in b.bins[p]}
    dissolved = np.array([any(i in injected for i in items) for items in a.bins])
    own = np.array(a.fills)
    dissolved |= own <= np.quantile(own, rng.random() * rng.choice([0.5, 1.0]))
    rest, loose = _without(a, dissolved, injected)
    rest.bins += [list(b.bins[p]) for p in picked]
    rest.fills += [b.fills[p] for p in picked]
    noise = rng.normal(0, rng.choice([0.0, 0.01, 0.1]) * capacity, len(loose)).tolist()
    order = sorted(range(len(loose)), key=lambda k: (noise[k] - lengths[loose[k]], loose[k]))
    return best_fit([loose[k] for k in order], lengths, capacity, rest)


def evolve(
    lengths: list[int], seeds: list[Packing], capacity: int, rng: np.random.Generator, children: int = CHILDREN
) -> tuple[Packing, int, int]:
    """The best packing, the crossovers it took, and the bins of the best start; a child replaces the worst."""
    least = -(-sum(lengths) // capacity)
    people = list(seeds)
    at_bound = any(len(p.bins) <= least for p in people)
    while len(people) < POPULATION and not at_bound:
        people.append(best_fit(rng.permutation(len(lengths)).tolist(), lengths, capacity))
    score = [p.fitness(capacity) for p in people]
    start, done, idle = -max(score)[0], 0, 0
    while done < children and idle < IDLE and -max(score)[0] > least:
        i, j = rng.choice(len(people), 2, replace=False)
        if score[i] < score[j]:
            i, j = j, i
        child = crossover(people[i], people[j], lengths, capacity, rng)
        worst = min(range(len(people)), key=score.__getitem__)
        value, before = child.fitness(capacity), max(score)[0]
        if value > score[worst]:
            people[worst], score[worst] = child, value
        done, idle = done + 1, 0 if value[0] > before else idle + 1
    return people[max(range(len(people)), key=score.__getitem__)], done, start


def _packed(frame: pd.DataFrame, found: Packing) -> pd.DataFrame:
    """One row per item: its bin, and its place there."""
    bin_of, place = np.empty(len(frame), dtype=np.int64), np.empty(len(frame), dtype=np.int64)
    lengths = frame["length"].to_numpy()
    for b, items in enumerate(found.bins):
        at = 0
        for i in items:
            bin_of[i], place[i] = b, at
            at += lengths[i]
    return frame.assign(bin=bin_of, offset=place)


def _first_epoch(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rid", ignore_index=True)
        shard, island = int(frame["shard"][0]), int(frame["island"][0])
        rng = np.random.default_rng([shard, island, 1])
        best, done, start = evolve(frame["length"].tolist(), [], capacity, rng)
        return _packed(frame, best).assign(crossovers=done, start_bins=start)

    return run


def _second_epoch(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(frame["shard"][0]), int(frame["target"][0])
        items = frame.drop_duplicates("rid").sort_values("rid", ignore_index=True)[["shard", "rid", "length"]]
        number = pd.Series(np.arange(len(items)), index=items["rid"].to_numpy())
        lengths = items["length"].tolist()
        elites = []
        for _, one in sorted(frame.groupby("island"), key=lambda g: g[0]):
            one = one.assign(item=number.loc[one["rid"].to_numpy()].to_numpy()).sort_values(["bin", "offset"])
            bins = [list(g) for g in one.groupby("bin")["item"].agg(list)]
            elites.append(Packing(bins, [sum(lengths[i] for i in b) for b in bins]))
        rng = np.random.default_rng([shard, island, 2])
        best, done, start = evolve(lengths, elites, capacity, rng)
        return _packed(items.assign(island=island), best).assign(crossovers=done, start_bins=start)

    return run


def _epochs(small: DataFrame, capacity: int, islands: int) -> tuple[DataFrame, DataFrame]:
    """Staged packings of each shard and island after the first epoch and after the second."""
    dealt = small.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), "rid", "length")
    tail = "bin long, offset long, crossovers long, start_bins long"
    kinds = f"shard long, island int, rid long, length long, {tail}"
    one = stage(dealt.groupBy("shard", "island").applyInPandas(_first_epoch(capacity), kinds), "epoch1")
    # Each island receives the elite of the one before it in the ring.
    met = one.withColumn("target", F.explode(F.array("island", (F.col("island") + 1) % islands)))
    names = f"shard long, rid long, length long, island int, {tail}"
    return one, stage(met.groupBy("shard", "target").applyInPandas(_second_epoch(capacity), names), "epoch2")


def _numbered(pieces: DataFrame, capacity: int, shard: int, shard_of: Column | None) -> tuple[DataFrame, DataFrame]:
    """Staged pieces with a number ``rid`` and a ``shard``, and those of them that are to be packed."""
    staged = stage(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    if shard_of is None:
        shards = max(1, -(-staged.where(F.col("length") < capacity).count() // shard))
        shard_of = F.pmod(F.xxhash64("rid"), F.lit(shards))
    staged = staged.withColumn("shard", shard_of.cast("long"))
    return staged, staged.where(F.col("length") < capacity)


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, shard_of: Column | None = None
) -> DataFrame:
    """``pieces`` with ``shard``, ``sequence_id`` and ``offset``; needs a ``length`` from 1 to ``capacity``.

    ``shard_of`` deals the pieces; otherwise a hash does.
    """
    staged, small = _numbered(pieces, capacity, shard, shard_of)
    _, two = _epochs(small, capacity, islands)
    used = two.groupBy("shard", "island").agg(F.max("bin").alias("bins"))
    best = used.groupBy("shard").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    won = two.join(best, ["shard", "island"]).select(
        "rid", ((F.shiftleft("shard", 32) + F.col("bin")) * 2 + 1).alias("sequence_id"), "offset"
    )
    full = staged.where(F.col("length") >= capacity).withColumns(
        {"sequence_id": F.col("rid") * 2, "offset": F.lit(0).cast("long")}
    )
    return staged.join(won, "rid").unionByName(full).drop("rid")


def history(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS) -> DataFrame:
    """(shard, island, epoch, start_bins, bins, crossovers, bound): what each island's epoch gained."""
    _, small = _numbered(pieces, capacity, shard, None)
    told = [
        found.groupBy("shard", "island", "start_bins", "crossovers")
        .agg((F.max("bin") + 1).alias("bins"), F.ceil(F.sum("length") / capacity).alias("bound"))
        .withColumn("epoch", F.lit(i))
        for i, found in enumerate(_epochs(small, capacity, islands), 1)
    ]
    return told[0].unionByName(told[1])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``documents`` -> pieces with their sequence and their place in it."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity).drop("shard")


def pack_in_order(
    docs: DataFrame, tokenizer: str, part: Column, row: Column, capacity: int = CAPACITY, shard: int = SHARD
) -> DataFrame:
    """As ``pack_documents``, for documents in an order: a sequence holds documents of one window of it.

    A document's place is ``row`` in its ``part``, and parts follow their numbers.
    The result also has ``position``, the document's place in the whole order, which
    tells copies apart, and ``window``, the window's place; windows hold about ``shard``
    documents each. Sorting by window, then sequence, gives the order of training.
    """
    pieces = stage(token_pieces(docs, tokenizer, capacity, place={"part": part, "row": row}), "tokens")
    sizes = pieces.where("piece = 0").groupBy("part").agg((F.max("row") + 1).alias("rows"))
    # One row a file.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("begin"))
    placed = pieces.join(begins, "part").withColumn("position", F.col("begin") + F.col("row")).drop("part", "row", "begin")
    found = pack(placed, capacity, shard, shard_of=F.floor(F.col("position") / shard))
    return found.withColumnRenamed("shard", "window")
