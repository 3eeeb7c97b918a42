"""Quality rules with risk-controlled cutoffs.

Fixed rules fail a text first. Every other text has a score of how bad it looks: the
highest, over four signals (symbols, repeated lines, repeated words, capitals), of the
log of how much likelier bad texts are than good ones to have that much of the signal.
Those ratios come from a third of the labels. The others certify, per stratum, a cutoff
of the score that with probability ``1 - DELTA`` over all strata rejects at most
``ALPHA`` of the stratum's good texts: cutoffs of a fixed grid are tested from the
strictest on, each by the exact binomial tail over the stratum's distinct good texts at the
level ``DELTA / strata``, and testing stops at the first that isn't certified. A chain of
tests in fixed order needs no further correction, and all certificates hold together, so
any certified cutoff may be taken: the strictest of those that part bad from good texts
best. A stratum with too few labels for any certificate (under about 107 good ones, with
four strata) rejects nothing.

Counts are pre-aggregated per signal or stratum and grid step; one task decides one
stratum from at most a grid's rows, and the driver sees at most a grid's rows a signal.

Defined cases: a null text has no words and fails; a null stratum is its own, apart from
the empty string; texts of any length go in whole; a text whose score ties with the
cutoff is rejected; labels given twice count as good only if all say so; null labels are
left out; repeated rows give a row each; an empty table gives an empty one; without
labels the fixed rules alone decide; ``judged`` ignores extra columns and
``drop_rejected`` keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, stage

ALPHA = 0.04
DELTA = 0.05
SIGNALS = ("symbols", "dup_lines", "repeats", "capitals")
# Steps of a signal, and the cutoffs of the score from strict to loose; fixed before any data is seen.
STEPS = tuple(float(x) for x in np.geomspace(50.0, 0.004, 160))
GRID = tuple(float(x) for x in np.linspace(8.0, 0.05, 160))
# One label of so many is for the ratios.
FIT = 3
# Bad texts that one good text weighs as much as, when certified cutoffs compete.
HARM = 5
FEWEST_WORDS = 10
SYMBOLS = "#*$%&|<>"
CAPITALS = bytes(range(65, 91))
WINDOW = 5


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur at least twice."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*[words[i:] for i in range(WINDOW)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = np.fromiter((w in often for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for i in range(WINDOW):
        covered[i : i + len(windows)] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals."""
    if not text:
        return (0,) * 7
    raw = text.encode()
    words = raw.split()
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - spaces,
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, CAPITALS)),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, text_hash, stratum, counts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(3)]
            found = np.array(rows, dtype=np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column(i) for i in range(3)] + [pa.array(found[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "stratum", *COUNTS])
        give_back()

    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col(stratum).cast("string").alias("stratum"),
        text.alias("text"),
    )
    kinds = "doc_id long, text_hash long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)
    return narrow.mapInArrow(run, kinds)


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def signal(name: str) -> Column:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "capitals": F.col("n_capitals") / chars,
    }[name]


def step(value: Column) -> Column:
    """The number of a signal's steps, from the highest on, that are above ``value``."""
    top, width = math.log(STEPS[0]), math.log(STEPS[0] / STEPS[-1]) / (len(STEPS) - 1)
    above = F.ceil((F.lit(top) - F.log(value)) / width)
    return F.when(value > 0, F.least(F.greatest(above, F.lit(0)), F.lit(len(STEPS)))).otherwise(len(STEPS)).cast("int")


def grid_step(score: Column) -> Column:
    """The number of cutoffs, from the strictest on, that don't reject ``score``."""
    return F.size(F.filter(F.array(*[F.lit(g) for g in GRID]), lambda g: g > score))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed exactly."""
    if k >= n:
        return 1.0
    log = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


def choose(counts: np.ndarray, alpha: float, delta: float) -> float:
    """The cutoff for ``counts[step] = (good, bad)`` texts; infinite if none is certified.

    A text of step ``i`` is rejected by the cutoffs from ``i`` on.
    """
    n = int(counts[:, 0].sum())
    rejected = np.cumsum(counts, axis=0)
    best, cutoff = 0, math.inf
    for (good, bad), value in zip(rejected.tolist(), GRID, strict=False):
        if not n or binomial_tail(good, n, alpha) > delta:
            break
        if (gain := bad - HARM * good) > best:
            best, cutoff = gain, value
    return cutoff


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that pass the fixed rules and have a label: with ``good`` 0/1 and whether they are ``for_fit``."""
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("good"))
    )
    rows = found.where(~base_failed()).join(good, "doc_id")
    return rows.withColumn("for_fit", F.pmod(F.xxhash64("doc_id"), F.lit(FIT)) == 0)


def ratios(rows: DataFrame) -> dict[str, list[float]]:
    """Of each signal, by step, the log of how much likelier bad texts are to reach it; unseen among bad ones is no evidence."""
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), step(signal(s)).alias("step")) for s in SIGNALS])).alias("x")
    counts = (
        rows.where("for_fit")
        .select("good", named)
        .groupBy("x.signal", "x.step")
        .agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad"))
        .collect()
    )
    table = {s: np.zeros((len(STEPS) + 1, 2)) for s in SIGNALS}
    for r in counts:
        table[r["signal"]][r["step"]] = r["good"], r["bad"]
    found = {}
    for name, per_step in table.items():
        reach, whole = per_step.cumsum(0), per_step.sum(0)
        found[name] = (np.log((reach[:, 1] + 0.01) / (whole[1] + 2)) - np.log((reach[:, 0] + 1) / (whole[0] + 2))).tolist()
    return found


def score(found: dict[str, list[float]]) -> Column:
    return F.greatest(*[F.get(F.array(*[F.lit(x) for x in found[s]]), step(signal(s))) for s in SIGNALS])


def cutoffs(rows: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoff) from labelled rows with a ``score``."""
    # Copies of one text are one trial, for the bound takes trials to be independent.
    trials = rows.where("NOT for_fit").groupBy("stratum", "text_hash", "score").agg(F.min("good").alias("good"))
    counts = (
        trials.groupBy("stratum", grid_step(F.col("score")).alias("step"))
        .agg(F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad"))
    )
    counts = stage(counts, "steps")
    strata = counts.select(F.struct("stratum").alias("s")).agg(F.count_distinct("s")).first()[0]

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((len(GRID) + 1, 2), dtype=np.int64)
        np.add.at(table, frame["step"].to_numpy(), frame[["good", "bad"]].to_numpy())
        return pd.DataFrame({"stratum": [frame["stratum"].iloc[0]], "cutoff": [choose(table, alpha, delta / max(1, strata))]})

    return counts.groupBy("stratum").applyInPandas(decide, "stratum string, cutoff double")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """(doc_id, text_hash, stratum, counts, base_failed, score, cutoff, kept) of every row."""
    found = stage(measured(docs, id_col, text_col, stratum), "measured")
    rows = stage(labelled(found, labels), "labelled")
    scored = score(ratios(rows))
    table = cutoffs(rows.withColumn("score", scored)).select(F.col("stratum").alias("of"), "cutoff")
    joined = found.join(table, F.col("stratum").eqNullSafe(F.col("of")), "left")
    rejected = F.coalesce(F.col("score") >= F.col("cutoff"), F.lit(False))
    return joined.select("doc_id", "text_hash", "stratum", *COUNTS, base_failed().alias("base_failed"), scored.alias("score"), "cutoff").withColumn(
        "kept", ~F.col("base_failed") & ~rejected
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    found = judged(docs, labels, id_col, text_col, stratum).where("kept")
    keep = found.select(F.struct("doc_id", "text_hash", "stratum").alias("own")).distinct()
    own = F.struct(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        F.col(stratum).cast("string").alias("stratum"),
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("own"))
    return rows.join(keep, "own", "left_semi").select([F.col(f"row.`{c}`").alias(c) for c in docs.columns])
