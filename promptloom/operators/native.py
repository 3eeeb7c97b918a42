"""Regions, segments, rule-based changes, capitals and undoing as column expressions: no Python worker.

Spans come from the offsets that matches and the gaps between them add up to; a change
inside a region goes by a filter over the regions; the changes that win, and the capitals
they owe, are ordered folds. The kinds of regions that one pattern finds are worked out
here; fences, labelled examples, tables and JSON need the scanner. ``covers`` tells which
texts hold none of these, and ``with_rewrite`` sends only the others to it.

Folds append to arrays, so the work on one text grows with the square of its changes,
not of its length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.dialect import FOLDED, for_java, held
from . import frames, scan
from .rewrite import SHIPPED, rules_for
from .rules import RULES

REGION = "array<struct<start:int,end:int,kind:string>>"
CHANGES = f"array<{frames.CHANGE}>"
_LINES = {label: for_java(p.replace("^", "(?<![^\\n])"), f) for label, p, f in patterns.LINES if label != "example tag"}
# What a text holds if the scanner may find more than patterns do: marks of a fence, an example, a table, or the start of JSON.
_SCANNED = [_LINES["fence"], _LINES["example label"], r"(?i)<example\b", r"\|[ \t]*:?-{2,}", r'\{[ \t\r\n]*"|\[[ \t\r\n]*["\[{0-9tfn-]|[\[{][ \t\r\n]{2,}[\]}]']


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    """The text in lower case, with all that may match an ASCII letter as that letter."""
    return F.lower(F.translate(text, *FOLDED))


def may_match(source: str, low: Column) -> Column:
    """Whether a text, ``folded``, holds what any match of a pattern holds."""
    some = held(source)
    return reduce(Column.__or__, [F.contains(low, F.lit(h)) for h in some]) if some else F.lit(True)


def spans(text: Column, pattern: str, groups: int = 0, possible: Column | None = None) -> Column:
    """All matches of a Java pattern: array of (start, end, m, g1, .. g<groups>), in code points; none unless ``possible``."""
    found = F.struct(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"m{i}") for i in range(groups + 1)], F.split(text, pattern, -1).alias("gaps"))

    def placed(x: Column) -> Column:
        n = F.size(x["m0"])
        # The sum of what stands before a match; the gap before it is its own.
        before = F.aggregate(
            F.arrays_zip(F.slice(x["gaps"], 1, n).alias("gap"), x["m0"].alias("m")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda acc, y: F.struct(
                (acc["at"] + F.length(y["gap"]) + F.length(y["m"])).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.length(y["gap"]))).alias("starts")
            ),
            lambda acc: acc["starts"],
        )
        columns = [before.alias("start"), *[x[f"m{i}"].alias(f"m{i}") for i in range(groups + 1)]]
        return F.transform(
            F.arrays_zip(*columns),
            lambda z: F.struct(z["start"].alias("start"), (z["start"] + F.length(z["m0"])).alias("end"), z["m0"].alias("m"), *[z[f"m{i}"].alias(f"g{i}") for i in range(1, groups + 1)]),
        )

    kind = "array<struct<start:int,end:int,m:string" + "".join(f",g{i}:string" for i in range(1, groups + 1)) + ">>"
    stands = text.rlike(pattern) if possible is None else possible & text.rlike(pattern)
    return F.when(stands, let(found, placed)).otherwise(F.array().cast(kind))


def covers(text: Column) -> Column:
    """Whether ``regions`` gives all regions of a text."""
    return ~reduce(Column.__or__, [text.rlike(p) for p in _SCANNED])


def regions(text: Column, low: Column | None = None) -> Column:
    """Accepted regions of the kinds that a pattern finds, by start: of overlapping ones that of the first kind, of one kind the first.

    ``low`` is the text ``folded``, where that is known already.
    """
    if low is None:
        return let(folded(text), lambda known: regions(text, known))

    def candidates(kind: str, at: int, source: str, flags: str) -> Column:
        def one(m: Column) -> Column:
            end = m["start"] + F.length(F.rtrim(m["m"], F.lit(scan.URL_TAIL))) if kind == "url" else m["end"]
            return F.struct(F.lit(at).alias("rank"), m["start"].alias("start"), (-end).alias("last"), F.lit(kind).alias("kind"))

        return F.filter(F.transform(spans(text, for_java(source, flags), possible=may_match(source, low)), one), lambda r: -r["last"] > r["start"])

    found = F.array_sort(F.concat(*[candidates(kind, scan.KINDS.index(kind), p, f) for kind, p, f in patterns.REGIONS]))

    def take(acc: Column, r: Column) -> Column:
        free = ~F.exists(acc, lambda a: (a["start"] < -r["last"]) & (r["start"] < a["end"]))
        own = F.array(F.struct(r["start"].alias("start"), (-r["last"]).alias("end"), r["kind"].alias("kind")))
        return F.when(free, F.concat(acc, own)).otherwise(acc)

    return F.array_sort(F.aggregate(found, F.array().cast(REGION), take))


def protected(found: Column, start: Column, end: Column) -> Column:
    """Whether a stretch shares a character with one of the regions."""
    return F.exists(found, lambda r: (start < r["end"]) & (r["start"] < end))


def segments(text: Column, found: Column) -> Column:
    """Pieces that join to the text: gaps without a kind, regions with theirs."""
    def piece(start: Column, end: Column, kind: Column) -> Column:
        return F.struct(F.substring(text, start + 1, end - start).alias("text"), kind.alias("kind"), start.alias("start"), end.alias("end"))

    def cut(r: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(r, lambda x: x["end"]))
        pairs = F.arrays_zip(r.alias("r"), F.slice(ends, 1, F.size(r)).alias("from"))
        each = F.transform(pairs, lambda p: F.array(piece(p["from"], p["r"]["start"], F.lit(None).cast("string")), piece(p["r"]["start"], p["r"]["end"], p["r"]["kind"])))
        rest = F.array(piece(F.element_at(ends, -1), F.length(text), F.lit(None).cast("string")))
        return F.filter(F.concat(F.flatten(each), rest), lambda s: s["start"] < s["end"])

    return let(found, cut)


def _replacement(rule: tuple, m: Column) -> tuple[Column, int]:
    """A rule's new text for a match, and how many of its groups that takes."""
    template = rule[5]
    if template.startswith("use:"):
        return F.concat(F.lit("us"), F.lower(m["g1"])), 1
    parts = template.replace("$$", "\0").split("$")
    pieces: list[Column] = [F.lit(parts[0].replace("\0", "$"))]
    for part in parts[1:]:
        pieces += [m["m"] if part[0] == "&" else m[f"g{part[0]}"], F.lit(part[1:].replace("\0", "$"))]
    return F.concat(*pieces), max([0, *(int(p[0]) for p in parts[1:] if p[0].isdigit())])


def candidates(text: Column, found: Column, level: str, low: Column | None = None) -> Column:
    """What the level's rules would change outside the regions, by start, then rule, the longest first."""
    if low is None:
        return let(folded(text), lambda known: candidates(text, found, level, known))
    ids = [r.id for r in rules_for(level, SHIPPED)]

    def hits(order: int, rule: tuple) -> Column:
        groups = _replacement(rule, {"m": F.lit(""), "g1": F.lit(""), "g2": F.lit("")})[1]

        def one(m: Column) -> Column:
            return F.struct(
                m["start"].alias("start"),
                F.lit(order).alias("order"),
                (-m["end"]).alias("last"),
                F.lit(rule[0]).alias("rule_id"),
                m["m"].alias("original"),
                _replacement(rule, m)[0].alias("replacement"),
                F.lit(rule[2]).alias("lossy"),
            )

        each = F.transform(spans(text, for_java(rule[3], rule[4]), groups, may_match(rule[3], low)), one)
        return F.filter(each, lambda c: (c["original"] != c["replacement"]) & ~protected(found, c["start"], -c["last"]))

    return F.array_sort(F.concat(*[hits(i, rule) for i, rule in enumerate(r for r in RULES if r[0] in ids)]))


def winners(sorted_candidates: Column) -> Column:
    """From left to right, each candidate that begins where the last winner has ended."""
    def change(c: Column) -> Column:
        return F.struct(
            c["rule_id"].alias("rule_id"),
            c["start"].alias("start"),
            (-c["last"]).alias("end"),
            c["original"].alias("original"),
            c["replacement"].alias("replacement"),
            c["lossy"].alias("lossy"),
            F.lit(None).cast("boolean").alias("capitalised"),
            F.array().cast("array<string>").alias("constraint_ids"),
        )

    return F.aggregate(
        sorted_candidates,
        F.struct(F.array().cast(CHANGES).alias("out"), F.lit(0).alias("at")),
        lambda acc, c: F.when(c["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.array(change(c))).alias("out"), (-c["last"]).alias("at"))).otherwise(acc),
        lambda acc: acc["out"],
    )


OPENING = r"(?:^|[\n.!?]|(?:^|\n)[ \t]*(?:[-*+]|[0-9]+\)))[ \t]*\z"


def capitalised(text: Column, changes: Column, found: Column) -> Column:
    """Changes that took a sentence's capital give it to what follows."""
    def with_(c: Column, **new: Column) -> Column:
        names = ("rule_id", "start", "end", "original", "replacement", "lossy", "capitalised", "constraint_ids")
        return F.struct(*[new.get(n, c[n]).alias(n) for n in names])

    def step(acc: Column, x: Column) -> Column:
        c, after = x["c"], x["after"]
        # What stands before a change is looked at only where a capital went.
        opens = c["original"].rlike(r"^\p{Lu}") & F.left(text, c["start"]).rlike(OPENING)

        def decided(due: Column) -> Column:
            at = F.regexp_instr(c["replacement"], F.lit(r"\p{L}"))
            letter = F.substring(c["replacement"], at, F.lit(1))
            lifts = (F.upper(letter) != letter) & (F.lower(letter) == letter)
            lifted = F.concat(F.left(c["replacement"], at - 1), F.upper(letter), F.substring(c["replacement"], at + 1, F.length(c["replacement"])))
            following = F.substring(text, c["end"] + 1, F.lit(1))
            apart = after.isNull() | (after > c["end"])
            taken = following.rlike(r"^\p{Ll}") & ~protected(found, c["end"], c["end"] + 1) & apart
            longer = with_(c, end=c["end"] + 1, original=F.concat(c["original"], following), replacement=F.concat(c["replacement"], F.upper(following)), capitalised=F.lit(True))
            empty = F.trim(c["replacement"]) == ""
            new = (
                F.when(due & (at > 0) & lifts, with_(c, replacement=lifted, capitalised=F.lit(True)))
                .when(due & (at == 0) & empty & ~F.coalesce(after == c["end"], F.lit(False)) & taken, longer)
                .otherwise(c)
            )
            owed = due & (at == 0) & empty & F.coalesce(after == c["end"], F.lit(False))
            return F.struct(F.concat(acc["out"], F.array(new)).alias("out"), owed.alias("owed"))

        return let(acc["owed"] | opens, decided)

    def fold(cs: Column) -> Column:
        starts = F.transform(cs, lambda c: c["start"])
        pairs = F.arrays_zip(cs.alias("c"), F.slice(starts, F.lit(2), F.size(cs)).alias("after"))
        begin = F.struct(F.array().cast(CHANGES).alias("out"), F.lit(False).alias("owed"))
        return F.aggregate(pairs, begin, step, lambda acc: acc["out"])

    return let(changes, lambda cs: F.when(F.size(cs) == 0, cs).otherwise(fold(cs)))


def spliced(text: Column, changes: Column) -> Column:
    """The text with the replacements of changes in place of what stands there; what overlaps an earlier one is left out."""
    ordered = F.array_sort(F.transform(changes, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["replacement"].alias("new"))))
    kept = F.aggregate(
        ordered,
        F.struct(F.array().cast("array<struct<start:int,end:int,new:string>>").alias("out"), F.lit(0).alias("at")),
        lambda acc, c: F.when(c["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.array(c)).alias("out"), c["end"].alias("at"))).otherwise(acc),
        lambda acc: acc["out"],
    )

    def pieces(cs: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(cs, lambda c: c["end"]))
        pairs = F.arrays_zip(cs.alias("c"), F.slice(ends, 1, F.size(cs)).alias("from"))
        each = F.transform(pairs, lambda p: F.concat(F.substring(text, p["from"] + 1, p["c"]["start"] - p["from"]), p["c"]["new"]))
        return F.concat(F.array_join(each, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    return F.when(F.size(changes) == 0, text).otherwise(let(kept, pieces))


def change_key(c: Column) -> Column:
    return F.concat_ws(":", c["rule_id"], c["start"], c["end"])


def with_native_rewrite(docs: DataFrame, level: str = "balanced", text: str = "text") -> DataFrame:
    """Adds regions, changes and output of texts that ``covers`` holds of; the ledger doesn't run."""
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Each step is a column of its own, so none is worked out twice.
    first = docs.select(row, said.alias("said")).select("*", folded(F.col("said")).alias("low")).select("*", regions(F.col("said"), F.col("low")).alias("regions"))
    chosen = first.select("*", winners(candidates(F.col("said"), F.col("regions"), level, F.col("low"))).alias("raw"))
    changed = chosen.select("row", "said", "regions", capitalised(F.col("said"), F.col("raw"), F.col("regions")).alias("changes"))
    out = changed.select("*", spliced(F.col("said"), F.col("changes")).alias("output"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("regions", "changes", "output")]
    return out.select(*kept, "regions", "changes", "output")


def with_rewrite(docs: DataFrame, level: str = "balanced", text: str = "text") -> DataFrame:
    """Adds output and changes at a level without a ledger: in the JVM where patterns find all regions, by the scanner elsewhere."""
    if level == "aggressive":
        raise ValueError("the ledger watches that level; use frames.with_rewrite")
    plain = covers(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    names = [c for c in docs.columns if c not in ("output", "changes")]
    here = with_native_rewrite(docs.where(plain), level, text).select(*[f"`{c}`" for c in names], "output", "changes")
    there = frames.with_rewrite(docs.where(~plain), level, text).select(*[f"`{c}`" for c in names], "output", "changes")
    return here.unionByName(there)


def with_choices(rewritten: DataFrame, disabled: DataFrame, key: str, text: str = "text", changes: str = "changes") -> DataFrame:
    """Adds ``undone`` (keys of changes taken back) and ``projected``, the output without them.

    ``disabled`` is (key, change): a row per change that a prompt's reader has switched
    off, whatever its order or number; a key of another prompt or of no change has no
    effect. Keys of a prompt are put together before they meet it, once each, so prompts
    are not multiplied; those with none keep all their changes.
    """
    each = rewritten.select(F.col(f"`{key}`").alias("of"), F.explode(changes).alias("c")).select("of", change_key(F.col("c")).alias("change")).distinct()
    off = disabled.select(F.col(f"`{key}`").alias("of"), F.col("change")).distinct()
    known = off.join(each, ["of", "change"], "left_semi").groupBy("of").agg(F.array_sort(F.collect_list("change")).alias("undone"))
    row = F.struct(*[F.col(f"`{c}`") for c in rewritten.columns]).alias("row")
    both = rewritten.select(row, F.col(f"`{key}`").alias("of")).join(known, "of", "left")
    undone = F.coalesce("undone", F.array().cast("array<string>"))
    left = F.filter(F.col(f"row.`{changes}`"), lambda c: ~F.array_contains(undone, change_key(c)))
    kept = [F.col(f"row.`{c}`").alias(c) for c in rewritten.columns if c not in ("undone", "projected")]
    return both.select(*kept, undone.alias("undone"), spliced(F.col(f"row.`{text}`"), left).alias("projected"))
