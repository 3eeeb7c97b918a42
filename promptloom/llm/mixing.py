"""Mixing sources to target weights along a time-varying curriculum.

Each source has a schedule, a piecewise-linear weight over training time 0 to 1;
its integral is the source's overall weight. The targets share ``budget`` times
all words by these weights, stop at ``most`` times a source's words, and pass the
rest on, which is one water level over the sources. Within a source, documents
follow one another in the order of a hash, once per pass; the words before a copy,
as a part of the target, are its demand, and inverting the schedule's integral
turns demand into the training time at which the copy is due. Sorting by range
of that time gives the training order.

A source may hold most rows: running sums are kept per slice of the hash, and
the slices' sums are summed before; slices and rows of a slice both grow with the
square root of a large source. Rows of one id stand in one slice. The table of sources
is small by nature; one task ranks it.

Defined cases: a null or blank text has size 0, is taken once if its source is
taken at all at its place, and counts nothing; a null source is the last source;
repeated rows are documents of their own; rows that tie in id follow by size, then by a
hash of all their columns; an empty table gives an empty one; extra columns pass through
untouched, but ``curriculum`` puts its ``mix`` in the place of one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS

# Knots (time, weight) of the schedules that sources take in turn; integrals 3, 1 and 2.
SCHEDULES = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))
BUDGET = 1.5
MOST = 2
# Documents of a slice of a source, about and at least.
SLICE = 2_000
# Sources up to which their table is broadcast; more are joined by a shuffle.
FEW_SOURCES = 10_000

Schedule = tuple[tuple[float, float], ...]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def integral(schedule: Schedule) -> float:
    """The overall weight of a schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def due(part: Column, schedule: Schedule) -> Column:
    """The time by which ``schedule`` has asked for ``part`` (0 to 1) of its whole demand."""
    whole, before, result = integral(schedule), 0.0, F.lit(schedule[-1][0])
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), before, area))
        before += area
    for t0, w0, slope, before, area in reversed(pieces):
        rest = F.greatest(part * whole - before, F.lit(0.0))
        # Root of slope/2 x^2 + w0 x = rest in the form that holds for slope 0 too.
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))) + w0
        x = F.when(root > 0, 2 * rest / root).otherwise(0.0)
        result = F.when(part * whole <= before + area, t0 + x).otherwise(result)
    return result


def source_targets(sizes: DataFrame, schedules: tuple[Schedule, ...], budget: float, most: int) -> DataFrame:
    """(no_source, name, source_size, n_docs, turn, target) of each source of (no_source, name, size)."""
    sources = sizes.groupBy("no_source", "name").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    turn = (F.row_number().over(Window.orderBy("no_source", "name")) - 1) % len(schedules)
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    ranked = sources.withColumn("turn", turn).withColumn("weight", F.get(weights, F.col("turn")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    # At the level, sources up to here are capped and all from here on get level times weight.
    order = Window.orderBy("ratio", "no_source", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = ranked.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no_source", "name", "level"))).over(whole)
    final = F.coalesce(fits["level"], F.lit(float("inf")))
    return leveled.select(
        "no_source",
        "name",
        "source_size",
        "n_docs",
        "turn",
        F.least(F.col("cap").cast("double"), final * F.col("weight")).alias("target"),
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """``docs`` and a struct ``mix``: size, source_size, target, and ``due``, the time of each copy taken; options as for ``placed``."""
    names = [F.col(f"row.`{c}`") for c in docs.columns if c != "mix"]
    return placed(docs, **options).select(*names, "mix")


def placed(
    docs: DataFrame,
    schedules: tuple[Schedule, ...] = SCHEDULES,
    budget: float = BUDGET,
    most: int = MOST,
    slice_rows: int = SLICE,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """(row, mix): each row of ``docs`` as a struct, and its place in the mix.

    ``size`` is the words of ``text`` unless it is given.
    """
    size = word_count(F.col("text")) if size is None else size
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(
        row.alias("row"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        size.alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("spot"),
        F.col(id_col).alias("id"),
        F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]).alias("tie"),
    )
    key = ["no_source", "name"]
    targets = source_targets(sized.select(*key, "size"), schedules, budget, most).checkpoint()
    slices = F.ceil(F.col("n_docs") / F.greatest(F.lit(float(slice_rows)), F.sqrt("n_docs")))
    place = F.conv(F.substring("spot", 1, 8), 16, 10).cast("long")
    cut = F.floor(place * slices / F.lit(1 << 32))
    few = targets.count() <= FEW_SOURCES
    with_slice = sized.join(F.broadcast(targets) if few else targets, key).withColumn("cut", cut)
    if not few:
        # Else what follows stays where the join put it, all rows of a source in one task.
        with_slice = with_slice.repartition(*key, "cut")
    in_order = Window.partitionBy("no_source", "name").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = with_slice.groupBy(*key, "cut").agg(F.sum("size").alias("inside"))
    sums = sums.select(*key, "cut", F.coalesce(F.sum("inside").over(in_order), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*key, "cut").orderBy("spot", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    found = with_slice.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, [*key, "cut"])
    ahead = F.col("inside") + F.col("ahead")

    def copy(number: int) -> Column:
        start = ahead + F.col("source_size") * number
        part = (start + F.col("size") / 2) / F.col("target")
        when = F.coalesce(*[F.when(F.col("turn") == i, due(part, s)) for i, s in enumerate(schedules)])
        return F.when(start < F.col("target"), F.least(when, F.lit(1.0)))

    mix = F.struct(
        "size", "source_size", "target", F.array_compact(F.array(*[copy(i) for i in range(most)])).alias("due")
    )
    return found.select("row", mix.alias("mix"))


def in_range(found: DataFrame, when: Column, tie: Column, partitions: int | None = None) -> DataFrame:
    """``found`` sorted by range of ``when``; ``tie`` splits what is due at one time."""
    key = when, tie
    ranged = found.repartitionByRange(partitions, *key) if partitions else found.repartitionByRange(*key)
    return ranged.sortWithinPartitions(*key)


def training_order(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """One row per copy with all columns of ``docs``, sorted by range of the time at which it is due."""
    tie = F.xxhash64(F.lit(0), *[F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    copies = placed(docs, **options).select("row", F.explode("mix.due").alias("due"), tie.alias("tie"))
    return in_range(copies, F.col("due"), F.col("tie"), partitions).select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])
