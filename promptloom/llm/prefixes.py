"""Conversation prefix trie by Patricia construction.

Each distinct sequence of first turns (role, text) is a node. Turns are range-sorted by
conversation and turn and cut into slices; what a prefix needs (its length, its text
bytes, four running sums of hashes of place and turn, which name it) is a running sum
inside a slice plus the sums of the slices before it, so a conversation of any length is
never one group. A node belongs to its smallest member, and members of a longer prefix
are members of a shorter one, so each conversation owns a suffix of its path: a chain.

Along a chain the number of members falls at branches and ends and is constant between
them, so the owner and that number name a compressed edge with its branch, end or leaf
point. Only these edges form the compressed tree. Sums over subtrees are worked out on
it by pointer doubling, in a number of rounds that grows with the logarithm of its depth.
Unary nodes are expanded at the end: what a node's subtree holds is what its edge's
subtree holds, less the part of the edge above the node, by the edge's running bytes.

Conversations that end at a node are hashed in order: sorted ids are joined to chunks
where they lie, and one pass per node hashes its chunks.

Defined cases: a null role or text is empty; a null turn comes first; turns of one
number go by the hash of role and text; repeated turns count each; rows without a
conversation are left out; texts of any length are hashed whole; an empty table gives an
empty one, without a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

KEY = ("k0", "k1", "k2", "k3")
NODE = ("depth", *KEY)
EDGE = ("owner", "n")
# Bytes of joined ids that are hashed at a time.
CHUNK = 1 << 20
MAX_ROUNDS = 60


def _parts(place: Column) -> list[Column]:
    """Four numbers of 32 bits of a turn at its place; their sums over a path name it."""
    one, two = F.xxhash64(place, "t1", "t2"), F.xxhash64(F.lit(7), "t2", place, "t1")
    return [f(h) for h in (one, two) for f in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))]


def sliced_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, slice, at, t1, t2, bytes): turns in order, numbered from 1 inside each slice of a range sort."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    turns = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.xxhash64(who, said).alias("t1"),
        F.xxhash64(F.lit("turn"), who, said).alias("t2"),
        F.octet_length(said).cast("long").alias("bytes"),
    )
    order = [F.asc_nulls_first("turn"), F.col("t1"), F.col("t2")]
    width = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = turns.repartitionByRange(width, "conv", *order).withColumn("slice", F.spark_partition_id())
    # Written with its slice, which another run of the range sort need not give again.
    cut = stage(cut, "turns")
    return cut.select("conv", "slice", F.row_number().over(Window.partitionBy("conv", "slice").orderBy(*order)).alias("at"), "t1", "t2", "bytes")


def _before(sums: DataFrame, columns: list[str]) -> DataFrame:
    """(conv, slice, columns summed over the conversation's earlier slices), of a row per conversation and slice."""
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("conv", "slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in columns])


def paths(turns: DataFrame, base: Column | None = None, head: Column | None = None, heads: int = 8) -> DataFrame:
    """(conv, slice, depth, last, t1, t2, bytes) of ``sliced_turns``; a row of depth 0 per conversation stands for its start.

    With ``base`` and ``head``, expressions of ``conv``: the conversation's first ``head``
    turns (at most ``heads``) are those of the conversation ``base``.
    """
    counts = turns.groupBy("conv", "slice").agg(F.max("at").cast("long").alias("turns"))
    counts = stage(counts, "slices")
    sizes = counts.groupBy("conv").agg(F.sum("turns").alias("turns"))
    spliced = sizes.select(
        "conv", "turns", (F.lit(0) if head is None else head).cast("long").alias("head"), (F.lit(None) if base is None else base).cast("long").alias("base")
    )
    of_base = sizes.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    taken = F.least("head", F.coalesce("base_turns", F.lit(0)))
    convs = spliced.join(of_base, "base", "left").select(
        "conv", "head", "base", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("turns") - F.col("head"))).alias("length")
    )
    convs = stage(convs, "convs")
    placed = turns.join(_before(counts, ["turns"]).join(convs, "conv"), ["conv", "slice"]).withColumn("place", F.col("turns_before") + F.col("at"))
    # Depth in the spliced conversation; a turn's place stays as long as it isn't spliced.
    own = placed.where(F.col("place") > F.col("head")).select(
        "conv", "slice", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "length", "t1", "t2", "bytes"
    )
    start = convs.select("conv", F.lit(-2).alias("slice"), F.lit(0).cast("long").alias("depth"), "length", *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "bytes")])
    every = own.unionByName(start)
    if base is not None:
        first = placed.where(F.col("place") <= heads).select(F.col("conv").alias("base"), F.col("place").alias("depth"), "t1", "t2", "bytes")
        borrowed = convs.where("head > 0").select("conv", "head", "base", "length").join(first, "base").where(F.col("depth") <= F.col("head"))
        every = every.unionByName(borrowed.select("conv", F.lit(-1).alias("slice"), "depth", "length", "t1", "t2", "bytes"))
    return every.select("conv", "slice", "depth", (F.col("depth") == F.col("length")).alias("last"), "t1", "t2", "bytes")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, last, bytes, cum, k0..k3, p0..p3) of ``paths``: bytes up to here, name of the prefix and of the one before it."""
    parts = [F.when(F.col("depth") == 0, 0).otherwise(p).alias(f"h{i}") for i, p in enumerate(_parts(F.col("depth")))]
    rows = stage(rows.select("*", *parts), "paths")
    summed = ["bytes", "h0", "h1", "h2", "h3"]
    running = Window.partitionBy("conv", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("conv", "slice").agg(*[F.sum(c).alias(c) for c in summed])
    here = rows.select("*", *[F.sum(c).over(running).alias(f"{c}_here") for c in summed]).join(_before(totals, summed), ["conv", "slice"])
    upto = {c: F.col(f"{c}_here") + F.col(f"{c}_before") for c in summed}
    names = [upto[f"h{i}"].alias(f"k{i}") for i in range(4)] + [(upto[f"h{i}"] - F.col(f"h{i}")).alias(f"p{i}") for i in range(4)]
    return here.select("conv", "depth", "last", "bytes", upto["bytes"].alias("cum"), *names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], names: list[str], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows of longs, but for a last column of bytes or text, in batches of about ``CHUNK`` bytes."""
    held, filled = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        last = pa.binary() if isinstance(columns[-1][0], bytes) else pa.string()
        kinds = [pa.int64()] * (len(names) - 1) + [last]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for row in rows:
        held.append(row)
        filled += size(row)
        if filled >= CHUNK:
            yield batch()
            held, filled = [], 0
    if held:
        yield batch()


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv) rows to (node, first, ids) chunks."""

    def chunks() -> Iterator[tuple]:
        key, ids, size = None, [], 0
        for *own, conv in _rows(batches):
            if ids and (own != key or size >= CHUNK):
                yield (*key, int(ids[0]), ",".join(ids).encode())
                ids, size = [], 0
            key = own
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if ids:
            yield (*key, int(ids[0]), ",".join(ids).encode())

    yield from _batches(chunks(), [*NODE, "first", "ids"], lambda r: 60 + len(r[-1]))


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first, ids) chunks in order to (node, ends_sha256)."""

    def digests() -> Iterator[tuple]:
        key, digest = None, None
        for *own, _, ids in _rows(batches):
            if own == key:
                digest.update(b",")
            else:
                if key is not None:
                    yield (*key, digest.hexdigest())
                key, digest = own, hashlib.sha256()
            digest.update(ids)
        if key is not None:
            yield (*key, digest.hexdigest())

    yield from _batches(digests(), [*NODE, "ends_sha256"], lambda r: 120)


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end, of ``prefixes``."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = ", ".join(f"{c} long" for c in NODE)
    ended = rows.where("last").select(*NODE, "conv")
    chunks = ended.repartitionByRange(width, *NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(_join_ids, f"{node}, first long, ids binary")
    dealt = chunks.repartition(width, *NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(_hash_chunks, f"{node}, ends_sha256 string")


def _linked(rows: DataFrame) -> DataFrame | None:
    """Nodes of ``prefixes`` with owner, members and those of their parents; None if there are none."""
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv").alias("owner"),
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(c) for c in ("bytes", "cum", "p0", "p1", "p2", "p3")],
    )
    nodes = stage(nodes, "nodes")
    root = nodes.where("depth = 0").first()
    if root is None:
        return None
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f"k{i}").alias(f"p{i}") for i in range(4)], F.col("owner").alias("up_owner"), F.col("n").alias("up_n"))
    lower = nodes.where("depth > 1").join(above.where("depth > 1"), ["depth", "p0", "p1", "p2", "p3"])
    # The root is the parent of all first turns, so they need no join.
    upper = nodes.where("depth <= 1").withColumns({f"up_{c}": F.when(F.col("depth") == 1, F.lit(root[c])).cast("long") for c in EDGE})
    return stage(lower.unionByName(upper).select(*NODE, "owner", "n", "bytes", "cum", "up_owner", "up_n"), "linked")


def compressed(linked: DataFrame) -> DataFrame:
    """(owner, n, point, start, up_owner, up_n, kids, leaves, saved): an edge with its branch, end or leaf point.

    ``leaves`` and ``saved`` are the edge's own; ``start`` is the bytes above it.
    """
    edges = linked.groupBy(*EDGE).agg(
        F.max("depth").alias("point"),
        F.min_by(F.struct("up_owner", "up_n"), "depth").alias("up"),
        F.max("cum").alias("cum"),
        F.min(F.col("cum") - F.col("bytes")).alias("start"),
    )
    edges = stage(edges.select(*EDGE, "point", "start", "cum", "up.up_owner", "up.up_n"), "edges")
    kids = edges.where(F.col("up_owner").isNotNull()).groupBy(F.col("up_owner").alias("owner"), F.col("up_n").alias("n")).agg(F.count(F.lit(1)).alias("kids"))
    return edges.join(kids, list(EDGE), "left").select(
        *EDGE,
        "point",
        "start",
        "up_owner",
        "up_n",
        F.coalesce("kids", F.lit(0)).alias("kids"),
        F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n") - 1) * (F.col("cum") - F.col("start"))).alias("saved"),
    )


def subtree_sums(tree: DataFrame) -> DataFrame:
    """``compressed`` with ``leaves`` and ``saved`` summed over each edge's subtree.

    After round k a row holds the sums over descendants less than 2 ** k edges below, and
    points to its ancestor 2 ** k edges above.
    """
    now = stage(tree.withColumns({"to_owner": F.col("up_owner"), "to_n": F.col("up_n")}), "sums")
    root = now.where(F.col("to_owner").isNull()).select(*EDGE).first()
    to_root = (F.col("to_owner") == root["owner"]) & (F.col("to_n") == root["n"])
    names = [c for c in now.columns if c not in ("to_owner", "to_n")]
    for _ in range(MAX_ROUNDS):
        moving = now.where(F.col("to_owner").isNotNull())
        if moving.isEmpty():
            return now.select(*names)
        gained = moving.groupBy(F.col("to_owner").alias("owner"), F.col("to_n").alias("n")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        onward = moving.select(F.col("owner").alias("to_owner"), F.col("n").alias("to_n"), F.col("to_owner").alias("on_owner"), F.col("to_n").alias("on_n"))
        jumped = moving.where(~to_root).join(onward, ["to_owner", "to_n"], "left").select(*names, F.col("on_owner").alias("to_owner"), F.col("on_n").alias("to_n"))
        # There is nothing above the root, so what points to it needs no join.
        halted = now.where(F.col("to_owner").isNull() | to_root).select(*names, *[F.lit(None).cast("long").alias(c) for c in ("to_owner", "to_n")])
        both = jumped.unionByName(halted).join(gained, list(EDGE), "left")
        now = stage(
            both.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("more_leaves", "more_saved"), "sums"
        )
    raise RuntimeError("the tree is deeper than 2 ** 60 edges")


TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(rows: DataFrame) -> DataFrame:
    """A row per node of ``paths``: smallest member, depth, the parent's, members, children, leaves, saved bytes, hash of ends."""
    rows = stage(prefixes(rows), "prefixes")
    linked = _linked(rows)
    if linked is None:
        return rows.sparkSession.createDataFrame([], TRIE)
    tree = subtree_sums(compressed(linked)).select(*EDGE, "point", "start", "kids", "leaves", "saved")
    every = linked.join(tree, list(EDGE)).join(ends(rows), list(NODE), "left")
    above = F.col("cum") - F.col("bytes") - F.col("start")
    return every.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("up_owner").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("point"), F.col("kids")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * above).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, base: Column | None = None, head: Column | None = None) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text); ``base`` and ``head`` splice them, see ``paths``."""
    return trie(paths(sliced_turns(conversations), base, head))
