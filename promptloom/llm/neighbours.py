"""Near-duplicate embeddings by range search on robust-pruned flat graphs.

Equal vectors of one label are one row with a count and a key. A label's vectors are
dealt to the ``overlap`` nearest of its pivots, so that shards overlap; pivots are a
hashed sample of bounded size, and pivots within reach of each other, directly or over
others, are one shard, so that a dense group stays together. A shard builds its graph:
candidates come from overlapping cells of the shard, and are robustly pruned, so that a
neighbour hides what lies closer to it than to the vertex. The lists that a vertex has
from its shards are united and go back to each of them. There every vertex is searched
for: a beam search from the medoid and from its own place, then an expansion along edges
through all that is within reach of the range. Only vectors that a search meets are
compared.

What it finds is verified by cosine in double precision; these pairs are the links that are
counted, each in one task, that of the first shard that holds both vectors, and the links
of the components. A shard that is too full is cut into blocks, and every two blocks are a
task, so a task's memory stays bounded. Recall is audited after every pass, on a bounded
sample of vectors against all vectors of their label; it is logged, and stands in the
result. Labels below the target, or all of them if the whole sample is, run again with
more overlap; where that isn't enough they are compared whole, every two blocks, without a
graph, which is exact and takes time with the square of the label.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and
vectors of a null label, link with nothing and are kept; a vector with a null id links like
any other and names no component that has another id; vectors of different lengths don't link; repeated rows, and rows that share an id, count as rows of their
own; ties don't matter, for every link counts; an empty table gives an empty one; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import connected_components

LOG = logging.getLogger(__name__)
COSINE = 0.93
# Vectors of a shard, about, and at most before it is cut into blocks.
SHARD, FULL = 640, 4096
PIVOTS = 16_384
OVERLAP, MOST_OVERLAP = 3, 9
# Bytes of all pivots.
PIVOT_BYTES = 64 << 20
# Vectors of a cell of a shard, about, and the cells of a vertex.
CELL, CELLS = 48, 3
# Candidates of a vertex, its neighbours after pruning, and the pruning's stretch.
CANDIDATES, DEGREE, STRETCH = 64, 24, 1.2
BEAM = 10
# Places that an expansion goes on from at a time.
STEP = 1 << 14
# How far under the range the expansion still walks.
SLACK = 0.06
AUDIT, RECALL = 256, 0.97

CLASS = "space string, key long, n long, vector array<double>"


def _vector(column: str) -> Column:
    return F.col(column).cast("array<double>")


def _space(vector_col: str, label_col: str) -> Column:
    return F.concat_ws(":", F.col(label_col).cast("string"), F.size(_vector(vector_col)).cast("string"))


def _prints(vector_col: str) -> list[Column]:
    """Two hashes by which vectors of a space are told apart."""
    return [F.xxhash64(F.lit(salt), _vector(vector_col)).alias(f"print{salt}") for salt in (0, 1)]


def valid(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Distinct vectors of each label: (space, print0, print1, vector, id, n, key)."""
    sound = F.forall(_vector(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(_vector(vector_col), lambda x: x != 0)
    ok = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    rows = vectors.where(ok & F.coalesce(sound & some, F.lit(False))).select(
        _space(vector_col, label_col).alias("space"), *_prints(vector_col), _vector(vector_col).alias("vector"), F.col(id_col).cast("long").alias("id")
    )
    found = rows.groupBy("space", "print0", "print1").agg(F.first("vector").alias("vector"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("key", F.monotonically_increasing_id())


def _unit(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return _normed(flat)


def _normed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots(classes: DataFrame, shard: int = SHARD, most: int = PIVOTS) -> dict[str, np.ndarray]:
    """Unit pivots of each space of more than ``shard`` vectors, ``most`` in all."""
    sizes = classes.groupBy("space").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > shard)
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    width = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    most = max(1, min(most, PIVOT_BYTES // (8 * width)))
    part = min(1 / shard, most / max(1, total))
    # A hashed share, of which at most ``most`` rows come to the driver.
    drawn = (
        classes.join(sizes, "space", "left_semi")
        .where(F.pmod(F.xxhash64("vector"), F.lit(1 << 31)) < int(part * (1 << 31)))
        .select("space", "vector")
        .limit(most)
        .collect()
    )
    found: dict[str, list] = {}
    for row in drawn:
        found.setdefault(row["space"], []).append(row["vector"])
    return {s: _normed(np.array(sorted(v))) for s, v in found.items()}


def reached(x: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit vector the least row that steps of ``cosine`` or above lead to."""
    n, x = len(x), x.astype(np.float32)
    label = np.arange(n)
    while True:
        new = label.copy()
        for i in range(0, n, 1024):
            low = np.where(x[i : i + 1024] @ x.T >= cosine, label.astype(np.int32), n).min(1)
            new[i : i + 1024] = np.minimum(new[i : i + 1024], low)
        np.minimum.at(new, label, new.copy())
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def dealt(classes: DataFrame, centres: dict[str, np.ndarray], overlap: int, cosine: float = COSINE) -> DataFrame:
    """``classes`` with the sorted list ``shards`` of each vector."""
    shared = classes.sparkSession.sparkContext.broadcast({s: (x, reached(x, cosine)) for s, x in centres.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = np.array(batch.column(0).to_pylist(), dtype=object)
            shards: list[list[int]] = [[0]] * len(spaces)
            for space in set(spaces.tolist()):
                if space not in shared.value:
                    continue
                near, group = shared.value[space]
                rows = np.flatnonzero(spaces == space)
                like = _unit(batch.column(3).take(pa.array(rows))) @ near.T
                k = min(overlap, near.shape[0])
                top = group[np.argpartition(-like, k - 1, axis=1)[:, :k]]
                for i, t in zip(rows.tolist(), top.tolist(), strict=True):
                    shards[i] = sorted(set(t))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shards, pa.list_(pa.int64()))], names=[*batch.schema.names, "shards"]
            )

    return classes.select("space", "key", "n", "vector").mapInArrow(run, CLASS + ", shards array<long>")


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, in the precision of ``x``."""
    step = 1 << 15
    return np.concatenate([np.einsum("ij,ij->i", x[a[i : i + step]], x[b[i : i + step]]) for i in range(0, len(a), step)] or [np.zeros(0, x.dtype)])


def candidates(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest vectors of each among those it shares a cell with, padded with -1, and their cosines, nearest first."""
    n = len(x)
    centres = x[np.random.default_rng(n).permutation(n)[: max(1, n // CELL)]]
    k = min(CELLS, len(centres))
    own = np.argpartition(-(x @ centres.T), k - 1, axis=1)[:, :k]
    order = np.argsort(own.ravel(), kind="stable")
    members = np.split(order // k, np.searchsorted(own.ravel()[order], np.arange(1, len(centres))))
    a, b, like = [], [], []
    for cell in members:
        near = x[cell] @ x[cell].T
        np.fill_diagonal(near, -2)
        most = min(CANDIDATES, len(cell) - 1)
        if most < 1:
            continue
        top = np.argpartition(-near, most - 1, axis=1)[:, :most]
        a.append(np.repeat(cell, most))
        b.append(cell[top].ravel())
        like.append(np.take_along_axis(near, top, 1).ravel())
    return _lists(n, *(np.concatenate(v) if v else np.zeros(0, t) for v, t in ((a, int), (b, int), (like, x.dtype))), CANDIDATES)


def _lists(n: int, a: np.ndarray, b: np.ndarray, like: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest distinct ``b`` of each ``a``, padded with -1, and their cosines."""
    _, once = np.unique(a * n + b, return_index=True)
    a, b, like = a[once], b[once], like[once]
    order = np.lexsort((-like, a))
    a, b, like = a[order], b[order], like[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    near = place < most
    found, value = np.full((n, most), -1), np.full((n, most), -2, dtype=like.dtype)
    found[a[near], place[near]] = b[near]
    value[a[near], place[near]] = like[near]
    return found, value


def robust_prune(x: np.ndarray, near: np.ndarray, like: np.ndarray, degree: int = DEGREE, stretch: float = STRETCH) -> np.ndarray:
    """Neighbours (rows of vertex numbers, padded with -1) kept of each vertex's candidates, nearest first.

    ``like`` holds the candidates' cosines; distances are square roots of ``2 - 2 cosine``.
    """
    n, width = near.shape
    own, rows = np.sqrt(np.maximum(2 - 2 * like, 0)), np.arange(n)
    alive = near >= 0
    kept = np.full((n, degree), -1)
    for k in range(degree):
        busy = np.flatnonzero(alive.any(1))
        if not len(busy):
            break
        first = alive[busy].argmax(1)
        chosen = near[busy, first]
        kept[busy, k] = chosen
        alive[busy, first] = False
        at, place = np.nonzero(alive[busy])
        between = np.sqrt(np.maximum(2 - 2 * _dots(x, chosen[at], near[busy[at], place]), 0))
        hidden = stretch * between <= own[busy[at], place]
        alive[busy[at[hidden]], place[hidden]] = False
    return kept


def build(x: np.ndarray) -> np.ndarray:
    """The pruned lists of a shard's unit vectors, with the edges that point to a vertex: the nearest ``2 * DEGREE`` of all."""
    x = x.astype(np.float32)
    kept = robust_prune(x, *candidates(x))
    a, b = np.repeat(np.arange(len(x)), kept.shape[1]), kept.ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    return _lists(len(x), a, b, _dots(x, a, b), 2 * DEGREE)[0]


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each vertex the least one that it is joined to, with the links (a, b) added."""
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, root[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new[root]
    return root


def search(x: np.ndarray, lists: np.ndarray, cosine: float, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (a, b), a < b, that searches for all vertices find, each once."""
    n, width = lists.shape
    low = x.astype(np.float32)
    rows = np.arange(n)
    found: list[np.ndarray] = []

    def keep(a: np.ndarray, b: np.ndarray, like: np.ndarray) -> None:
        # Double precision decides, once for each pair.
        near = np.flatnonzero(like >= cosine - 1e-4)
        found.append(np.unique(np.minimum(a[near], b[near]) * n + np.maximum(a[near], b[near])))

    a, b = np.repeat(rows, width), lists.ravel()
    a, b = a[b >= 0], b[b >= 0]
    keep(a, b, _dots(low, a, b))
    # Beam search, all vertices at once.
    medoid = int((low @ low.mean(0)).argmax())
    seen = np.zeros((n, n), dtype=bool)
    seen[:, medoid] = seen[rows, rows] = True
    beam = np.full((n, BEAM), -1)
    value = np.full((n, BEAM), -3, dtype=np.float32)
    beam[:, 0], value[:, 0] = medoid, low @ low[medoid]
    beam[:, 1], value[:, 1] = np.where(rows == medoid, -1, rows), np.where(rows == medoid, -3, 1)
    opened = beam < 0
    own = np.flatnonzero(value[:, 0] >= cosine - slack)
    own = own[own != medoid]
    waiting = [(own, np.full(len(own), medoid))]
    keep(own, waiting[0][1], value[own, 0])
    while True:
        closed = np.where(opened, -3, value)
        best = closed.argmax(1)
        busy = np.flatnonzero(closed[rows, best] > -3)
        if not len(busy):
            break
        opened[busy, best[busy]] = True
        q, v = np.repeat(busy, width), lists[beam[busy, best[busy]]].ravel()
        fresh = np.flatnonzero((v >= 0) & ~seen[q, v])
        at, q, v = fresh % width, q[fresh], v[fresh]
        seen[q, v] = True
        like = _dots(low, q, v)
        near = like >= cosine - slack
        waiting.append((q[near], v[near]))
        keep(q, v, like)
        new, score = np.full((n, width), -1), np.full((n, width), -3, dtype=np.float32)
        new[q, at], score[q, at] = v, like
        both, score = np.concatenate([beam, new], 1), np.concatenate([value, score], 1)
        done = np.concatenate([opened, new < 0], 1)
        top = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
        beam, value, opened = (np.take_along_axis(m, top, 1) for m in (both, score, done))
    # Expansion: along edges, through everything within reach of the range, some at a time.
    while waiting:
        q, v = waiting.pop()
        if len(q) > STEP:
            waiting.append((q[STEP:], v[STEP:]))
            q, v = q[:STEP], v[:STEP]
        q, v = np.repeat(q, width), lists[v].ravel()
        fresh = v >= 0
        q, v = q[fresh], v[fresh]
        fresh = ~seen[q, v]
        code = np.unique(q[fresh] * n + v[fresh])
        q, v = code // n, code % n
        seen[q, v] = True
        like = _dots(low, q, v)
        near = like >= cosine - slack
        if near.any():
            waiting.append((q[near], v[near]))
            keep(q, v, like)
    code = np.unique(np.concatenate(found))
    a, b = code // n, code % n
    sure = _dots(x, a, b) >= cosine
    return a[sure], b[sure]


def _lists_frame(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("key", ignore_index=True)
    keys = frame["key"].to_numpy()
    lists = build(_normed(np.stack(frame["vector"].to_numpy())))
    return pd.DataFrame({"key": keys, "near": [keys[r[r >= 0]].tolist() for r in lists]})


def least_common(shards: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least shard that both vectors of each pair are in."""
    most = max(map(len, shards))
    padded = np.full((len(shards), most), -1)
    for i, s in enumerate(shards):
        padded[i, : len(s)] = s
    out = np.full(len(a), -1)
    # Shards are sorted, so the last one that is written is the least.
    for k in reversed(range(most)):
        mine = padded[a, k]
        met = (mine >= 0) & (padded[b] == mine[:, None]).any(1)
        out[met] = mine[met]
    return out


def _searched_frame(cosine: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        keys, weight, block, n = frame["key"].to_numpy(), frame["n"].to_numpy(), frame["block"].to_numpy(), len(frame)
        x = _normed(np.stack(frame["vector"].to_numpy()))
        near = [np.searchsorted(keys, r) for r in frame["near"]]
        near = [p[(p < n) & (keys[np.minimum(p, n - 1)] == r)] for p, r in zip(near, frame["near"], strict=True)]
        lists = np.full((n, max(1, max(map(len, near)))), -1)
        for i, r in enumerate(near):
            lists[i, : len(r)] = r
        a, b = search(x, lists, cosine)
        root = _roots(np.arange(n), a, b)
        # Each pair counts in one task: that of its own two blocks in the first shard that holds both.
        first, last = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        mine = (np.minimum(block[a], block[b]) == first) & (np.maximum(block[a], block[b]) == last)
        a, b = a[mine], b[mine]
        mine = least_common(list(frame["shards"]), a, b) == int(frame["shard"].iloc[0])
        a, b = a[mine], b[mine]
        links = np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
        return pd.DataFrame({"space": frame["space"], "key": keys, "links": links, "to": keys[root]})

    return run


def _whole_frame(cosine: float):
    """All pairs of a task, in double precision."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        keys, weight, block = (frame[c].to_numpy() for c in ("key", "n", "block"))
        x, n = _normed(np.stack(frame["vector"].to_numpy())), len(frame)
        low, links, root = x.astype(np.float32), np.zeros(n, dtype=np.int64), np.arange(n)
        first, last = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        for i in range(0, n, 512):
            a, b = np.nonzero(low[i : i + 512] @ low.T >= cosine - 1e-4)
            a = a + i
            a, b = a[a < b], b[a < b]
            # A pair counts in the task of its own two blocks.
            mine = (np.minimum(block[a], block[b]) == first) & (np.maximum(block[a], block[b]) == last)
            a, b = a[mine], b[mine]
            sure = _dots(x, a, b) >= cosine
            a, b = a[sure], b[sure]
            links += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
            root = _roots(root, a, b)
        return pd.DataFrame({"space": frame["space"], "key": keys, "links": links, "to": keys[root]})

    return run


def linked(deal: DataFrame, cosine: float, full: int = FULL, whole: bool = False) -> DataFrame:
    """(space, key, links, to): a row per vector, shard and block pair, with the least key it reaches there.

    ``links`` are the vector's links of which this is the task. ``whole`` compares all pairs
    of each shard, whose shards mustn't overlap; otherwise the graph is searched.
    """
    spread = deal.select("space", "key", "n", "vector", "shards", F.explode("shards").alias("shard"))
    fill = spread.groupBy("space", "shard").agg(F.count(F.lit(1)).alias("rows"))
    blocks = fill.select("space", "shard", F.ceil(F.col("rows") * 2 / full).cast("int").alias("blocks"))
    blocks = blocks.withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    placed = spread.join(blocks, ["space", "shard"]).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    paired = placed.select("*", other).select("space", "shard", low, high, "block", "key", "n", "vector", "shards")
    task = ["space", "shard", "low", "high"]
    out = "space string, key long, links long, to long"
    if whole:
        return paired.groupBy(*task).applyInPandas(_whole_frame(cosine), out)
    lists = paired.groupBy(*task).applyInPandas(_lists_frame, "key long, near array<long>")
    united = lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = stage(united, "graph")
    return paired.join(united, "key").groupBy(*task).applyInPandas(_searched_frame(cosine), out)


def audit(classes: DataFrame, counted: DataFrame, cosine: float, sample: int = AUDIT) -> dict[str, tuple[int, int]]:
    """By space, how many links of a hashed sample of vectors ``counted`` (key, links) has, and how many there are."""
    queries = classes.orderBy(F.xxhash64("vector"), "key").limit(sample).select("space", "key", "vector").collect()
    by_space: dict[str, tuple[list[int], np.ndarray]] = {}
    for space in {q["space"] for q in queries}:
        own = [q for q in queries if q["space"] == space]
        by_space[space] = [q["key"] for q in own], _normed(np.array([q["vector"] for q in own]))
    shared = classes.sparkSession.sparkContext.broadcast(by_space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            spaces = np.array(batch.column(0).to_pylist(), dtype=object)
            ids, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for space, (names, x) in shared.value.items():
                rows = np.flatnonzero(spaces == space)
                if not len(rows):
                    continue
                hit = _unit(batch.column(3).take(pa.array(rows))) @ x.T >= cosine
                for i, name in enumerate(names):
                    total[name] = total.get(name, 0) + int(n[rows[hit[:, i] & (ids[rows] != name)]].sum())
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["key", "links"])

    all_links = classes.select("space", "key", "n", "vector").mapInArrow(run, "key long, links long")
    exact = all_links.groupBy("key").agg(F.sum("links").alias("exact"))
    rows = exact.join(counted, "key", "left").select("key", "exact", F.least("exact", F.coalesce("links", F.lit(0))).alias("got"))
    held = {r["key"]: (r["got"], r["exact"]) for r in rows.collect()}
    of = {s: [held[i] for i in set(names) if i in held] for s, (names, _) in by_space.items()}
    return {s: (sum(g for g, _ in v), sum(e for _, e in v)) for s, v in of.items()}


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    recall: float = RECALL,
) -> DataFrame:
    """(id, n_links, component_id, recall) of every row; ``recall`` is the share of its label's links that the audit found."""
    classes = stage(valid(vectors, id_col, vector_col, label_col), "vectors")
    centres = pivots(classes)
    todo, parts, overlap = classes, [], OVERLAP
    while True:
        deal = stage(dealt(todo, centres, overlap, cosine), "dealt")
        found = stage(linked(deal, cosine, whole=overlap == 0), "links")
        forest = found.select(F.col("key").alias("src"), F.col("to").alias("dst"))
        components = connected_components(forest).select(F.col("id").alias("key"), F.col("component_id").alias("component"))
        components = stage(components.join(todo.select("key", "space"), "key"), "components")
        links = found.groupBy("key").agg(F.sum("links").alias("links"))
        links = stage(links.join(todo.select("key", "space"), "key"), "counted")
        if overlap == 0:
            parts.append((components, links.withColumn("recall", F.lit(1.0))))
            break
        checked = audit(todo, links, cosine)
        rates = {s: g / e if e else 1.0 for s, (g, e) in checked.items()}
        for s, rate in sorted(rates.items()):
            LOG.info("recall of %s with %d shards a vector: %.4f", s, overlap, rate)
        measured = F.coalesce(F.create_map(*[F.lit(v) for pair in rates.items() for v in pair])[F.col("space")], F.lit(1.0)) if rates else F.lit(1.0)
        links = links.withColumn("recall", measured)
        got, exact = (sum(v[k] for v in checked.values()) for k in (0, 1))
        low = [s for s, (g, e) in checked.items() if g < recall * e]
        short = F.lit(True) if got < recall * exact else F.col("space").isin(low)
        parts.append((components.where(~short), links.where(~short)))
        if got >= recall * exact and not low:
            break
        shards = max((len(c) for s, c in centres.items() if got < recall * exact or s in low), default=1)
        todo = stage(todo.where(short), "short")
        overlap = min(overlap * 2 - 1, MOST_OVERLAP) if overlap < min(shards, MOST_OVERLAP) else 0
        if overlap == 0:
            centres = {}
    components = reduce(DataFrame.unionByName, [c for c, _ in parts]).select("key", "component")
    links = reduce(DataFrame.unionByName, [k for _, k in parts]).select("key", "links", "recall")
    # A component is named by its least id, which its least key needn't have.
    least = components.join(classes.select("key", "id"), "key").groupBy("component").agg(F.min("id").alias("least"))
    named = (
        classes.select("space", "print0", "print1", "key", "id", "n")
        .join(links, "key", "left")
        .join(components.join(least, "component"), "key", "left")
        .select(
            "space",
            "print0",
            "print1",
            F.coalesce("least", "id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            "recall",
        )
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.col(label_col).isNotNull(), _space(vector_col, label_col)).alias("space"),
        *_prints(vector_col),
    )
    return rows.join(named, ["space", "print0", "print1"], "left").select(
        "id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("recall", F.lit(1.0)).alias("recall"),
    )
