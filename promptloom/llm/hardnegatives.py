"""Hard-negative mining by distributed radix selection.

Vectors become integers, so scores are exact inner products. Rows are dealt to cells of
about ``CELL`` rows by a hash, anchors to blocks of about ``BLOCK``; each block meets
each cell once per pass, as one group of bounded size. A window asks for the ``k`` rows
of an anchor's same or other labels that score highest between two bounds. A row's
distance from the upper bound is read as digits: in each pass every cell counts, per
window, the next digit of the rows that agree with the digits chosen so far, and only up
to the digit at which its own rows make up ``k``, for the k-th row of all can't lie beyond
that. Sums of these counts locate the digit of the k-th row, pass by pass. A last pass
gathers the rows below the located distance, and of those at it, as far as they may be
among the first by id, at most ``k`` a cell.

First the positives are selected in this way, then the negatives in the windows that the
positives' scores give.

Defined cases: rows with a null label or vector, or a null or non-finite component, take
no part; vectors of unequal length are multiplied as far as the shorter one goes; an
empty vector scores 0; a row of an anchor's own id is no other row; a null id is no
anchor and comes last among ties; repeated rows count each, but an anchor that stands
twice alike asks once; scores beyond a long are an error; an empty table gives an empty
one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

POSITIVES, NEGATIVES = 5, 10
SCALE = 256
# Rows of a cell and anchors of a block, about; cells at least.
CELL, BLOCK, FEWEST_CELLS = 4096, 1024, 16
# Bits of a digit.
DIGIT = 10
# Doubles hold integers up to here.
EXACT = 1 << 53

WINDOWS = "array<struct<slot:int,low:long,high:long,found:long,wanted:int>>"


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def usable(label: Column, vector: Column) -> Column:
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))

    return label.isNotNull() & vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None) -> tuple[DataFrame, int]:
    """(cell, id, label, q) of the rows that take part, as integers, and the number of cells. ``label`` replaces the label column."""
    kept = rows.where(usable(F.col(f"`{label_col}`"), F.col(f"`{vector_col}`"))).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.col(f"`{label_col}`") if label is None else label).cast("long").alias("label"),
        integers(F.col(f"`{vector_col}`")).alias("q"),
        F.monotonically_increasing_id().alias("row"),
    )
    kept = stage(kept, "vectors")
    cells = max(FEWEST_CELLS, -(-kept.count() // CELL))
    # Rows are numbered, so that copies, however many, are spread too.
    return kept.select(F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int").alias("cell"), "id", "label", "q"), cells


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products, exact: by doubles where they hold them, else by longs."""
    high = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    most = high(rows) * high(anchors) * max(1, rows.shape[1])
    if most >= 2.0**63:
        raise OverflowError("scores don't fit a long")
    if most < EXACT:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors @ rows.T


class _Cell:
    """The rows of one cell and the anchors of one block, with their scores."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        size = lambda t: int(t.column("q").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) if len(t) else 0
        width = max(size(rows), size(anchors))
        self.scores = scores(_matrix(rows.column("q"), width), _matrix(anchors.column("q"), width))
        ids = rows.column("id")
        self.no_id = ids.is_null().to_numpy()
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.anchors = anchors.select(["anchor", "id", "label", "windows"]).to_pylist()

    def windows(self, same: bool) -> Iterator[tuple[int, dict, np.ndarray, np.ndarray]]:
        """(anchor, window, its rows, their distances from its upper bound)."""
        for at, one in enumerate(self.anchors):
            fits = self.labels == one["label"]
            own = np.flatnonzero(fits & ((self.ids != one["id"]) | self.no_id) if same else ~fits)
            found = self.scores[at][own]
            for w in one["windows"]:
                inside = (found >= w["low"]) & (found <= w["high"])
                yield one["anchor"], w, own[inside], w["high"] - found[inside]


def _counter(same: bool, shift: int):
    """Counts of the digit at ``shift`` of each window's rows that agree with the digits found."""

    def run(_, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows) and len(anchors):
            for anchor, w, _, far in _Cell(rows, anchors).windows(same):
                digits = far[far >> (shift + DIGIT) == w["found"]] >> shift
                if not len(digits):
                    continue
                if len(digits) > w["wanted"]:
                    digits = digits[digits <= np.partition(digits, w["wanted"] - 1)[w["wanted"] - 1]]
                values, counts = np.unique(digits, return_counts=True)
                out += [(anchor, w["slot"], v, n) for v, n in zip(values.tolist(), counts.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "slot", "digit", "n"])

    return run, "anchor long, slot int, digit long, n long"


def _gatherer(same: bool):
    """Each window's rows nearer than the distance found, and of those at it the ones that may be among the first."""

    def run(_, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows) and len(anchors):
            cell = _Cell(rows, anchors)
            for anchor, w, own, far in cell.windows(same):
                ties = own[far == w["found"]]
                order = np.lexsort((cell.ids[ties], cell.no_id[ties]))[: w["wanted"]]
                for at, d in [(i, d) for i, d in zip(own[far < w["found"]], far[far < w["found"]], strict=True)] + [(i, w["found"]) for i in ties[order]]:
                    out.append((anchor, w["slot"], None if cell.no_id[at] else int(cell.ids[at]), int(w["high"] - d)))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "slot", "id", "score"])

    return run, "anchor long, slot int, id long, score long"


def _meet(rows: DataFrame, cells: int, anchors: DataFrame, blocks: int, work: tuple) -> DataFrame:
    """``work`` on each cell of rows with each block of anchors."""
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(*work)


def select(rows: DataFrame, cells: int, anchors: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """(anchor, slot, rank, id, score): of each window of ``anchors`` the first ``k`` rows.

    ``rows`` is (cell, id, label, q), ``anchors`` (block, anchor, id, label, q, windows), a
    window (slot, low, high) of which ``found`` and ``wanted`` are filled here.
    """
    widest = anchors.select(F.max(F.array_max(F.transform("windows", lambda w: w["high"] - w["low"])))).first()[0]
    if widest is None:
        return rows.sparkSession.createDataFrame([], "anchor long, slot int, rank int, id long, score long")
    fill = F.transform("windows", lambda w: F.struct(w["slot"].alias("slot"), w["low"].alias("low"), w["high"].alias("high"), F.lit(0).cast("long").alias("found"), F.lit(k).alias("wanted")))
    now = stage(anchors.withColumn("windows", fill), "windows")
    for shift in range((max(1, widest.bit_length()) - 1) // DIGIT * DIGIT, -1, -DIGIT):
        counts = _meet(rows, cells, now, blocks, _counter(same, shift)).groupBy("anchor", "slot", "digit").agg(F.sum("n").alias("n"))
        # A window has at most ``k`` digits up to its k-th row in each cell, most of them the same.
        upto = Window.partitionBy("anchor", "slot").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        reached = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        each = now.select("anchor", F.inline("windows"))
        chosen = (
            reached.join(each.select("anchor", "slot", "wanted"), ["anchor", "slot"])
            .where(F.col("before") < F.col("wanted"))
            # The digit at which the k-th row stands, or the last one if there are fewer.
            .groupBy("anchor", "slot")
            .agg(F.max_by(F.struct("digit", "before"), "digit").alias("at"))
        )
        next_ = each.drop("found", "wanted").join(chosen, ["anchor", "slot"])
        wanted = each.select("anchor", "slot", "wanted").join(next_, ["anchor", "slot"])
        packed = wanted.groupBy("anchor").agg(
            F.sort_array(
                F.collect_list(
                    F.struct("slot", "low", "high", F.col("at.digit").alias("found"), (F.col("wanted") - F.col("at.before")).cast("int").alias("wanted"))
                )
            ).alias("windows")
        )
        now = stage(now.drop("windows").join(packed, "anchor"), "windows")
    found = _meet(rows, cells, now, blocks, _gatherer(same))
    # Limited per task before rows are shuffled.
    first = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("anchor", "slot", "rank", "id", "score")


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    least: int = 30,
    most: int = 90,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``; a negative scores ``least`` to ``most`` per
    cent of its positive.
    """
    dealt, cells = prepared(rows, id_col, vector_col, label_col, label)
    key = F.xxhash64("id", "label", "q")
    asked = dealt.where(is_anchor & F.col("id").isNotNull()).select("id", "label", "q", key.alias("anchor")).dropDuplicates(["anchor"])
    asked = stage(asked, "anchors")
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod("anchor", F.lit(blocks)).cast("int"))
    # No score lies beyond the product of the longest lengths.
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = dealt.select(F.max(length("q"))).first()[0]
    if longest is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    reach = (F.floor(length("q") * longest * (1 + 1e-9)) + 1).cast("long")
    window = lambda slot, low, high: F.struct(slot.cast("int").alias("slot"), low.alias("low"), high.alias("high"))
    first = select(dealt, cells, asked.withColumn("windows", F.array(window(F.lit(0), -reach, reach))), blocks, True, positives)
    first = stage(first, "positives")
    low, high = F.ceil(F.col("score") * least / F.lit(100).cast("decimal(3,0)")), F.floor(F.col("score") * most / F.lit(100).cast("decimal(3,0)"))
    bounds = first.withColumns({"low": low.cast("long"), "high": high.cast("long")}).where(F.col("low") <= F.col("high"))
    packed = bounds.groupBy("anchor").agg(F.sort_array(F.collect_list(window(F.col("rank"), F.col("low"), F.col("high")))).alias("windows"))
    last = select(dealt, cells, asked.join(packed, "anchor"), blocks, False, negatives)
    told = first.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = last.join(told, ["anchor", "slot"]).join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
