"""The operators over DataFrames of prompts.

Each adds columns to its rows, looks at one row at a time and shuffles nothing,
so it runs unchanged on a stream. One Arrow-batched function does all that a row
needs; batches are cut by Spark, a null prompt counts as an empty one. A column that an
operator adds takes the place of one of that name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, _parse_datatype_string

from . import layout, ledger, scan
from .rewrite import LEVELS, SHIPPED, Change, Rule, apply, diff_items, rewrite

CHANGE = "struct<rule_id:string,start:int,end:int,original:string,replacement:string,lossy:boolean,capitalised:boolean,constraint_ids:array<string>>"
CONSTRAINT = "struct<id:string,type:string,severity:string,anchor:string,start:int,end:int,sentence:string,sentence_start:int,sentence_end:int,label:string>"
CHECK = "struct<id:string,type:string,severity:string,preserved:boolean,evidence:string,before:int,after:int>"
GROUP = "struct<type:string,members:array<string>,start:int,similarity:double,suggestion:string>"
SEGMENT = "struct<text:string,kind:string,start:int,end:int>"
MARKER = "struct<kind:string,text:string,start:int,end:int,line:int>"
DIFF = "struct<kind:string,start:int,end:int,text:string,key:string,active:boolean>"


# Rows whose results are Python objects at one time.
SLICE = 256
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow_type(kind: DataType) -> pa.DataType:
    if isinstance(kind, StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, MapType):
        return pa.map_(arrow_type(kind.keyType), arrow_type(kind.valueType))
    return _ARROW[kind.simpleString()]


def _columns(docs: DataFrame, inputs: list[str], schema: str, function: Callable[..., tuple]) -> DataFrame:
    """``docs`` with the columns of ``schema``, worked out from ``inputs`` of each row."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    names, types = kind.names, [arrow_type(f.dataType) for f in kind.fields]

    def run(*given: pa.Array) -> pa.Array:
        values, done = list(zip(*[g.to_pylist() for g in given], strict=True)), []
        for at in range(0, max(1, len(values)), SLICE):
            rows = [function(*(v or "" for v in row)) for row in values[at : at + SLICE]]
            # Built by Arrow from each column's values, with no Python converter per field.
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            done.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names))
        return pa.concat_arrays(done)

    # Said to be non-deterministic, or filters that Spark infers, as for explode, would call it once more.
    worked = F.arrow_udf(run, kind).asNondeterministic()(*[F.col(f"`{c}`").cast("string") for c in inputs])
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in names]
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), worked.alias("worked"))
    return both.select(*kept, *[F.col(f"worked.{n}").alias(n) for n in names])


def _change(c: Change) -> dict:
    return {**vars(c), "constraint_ids": list(c.constraint_ids)}


def check_row(k: ledger.Check) -> dict:
    c = k.constraint
    return {"id": c.id, "type": c.type, "severity": c.severity, "preserved": k.preserved, "evidence": k.evidence, "before": k.before, "after": k.after}


def with_segments(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``segments``: pieces of the prompt, protected ones with their kind."""
    names = ("text", "kind", "start", "end")
    return _columns(docs, [text], f"segments array<{SEGMENT}>", lambda t: ([dict(zip(names, s, strict=True)) for s in scan.segments(t)],))


def with_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sentences``: those of the prompt, without the space around them."""
    return _columns(docs, [text], "sentences array<struct<text:string,start:int,end:int>>", lambda t: ([s._asdict() for s in scan.sentences(t)],))


def with_rewrite(
    docs: DataFrame,
    level: str = "balanced",
    text: str = "text",
    rules: Iterable[Rule] = SHIPPED,
    disabled: Iterable[str] = (),
    enforce: bool | None = None,
    duplicates: bool = False,
) -> DataFrame:
    """Adds output, changes, blocked and the ledger's rounds; and, where the ledger ran, checks.

    With ``duplicates`` it also adds those of ``with_duplicates``, from the same inventory.
    """
    # The shipped rules are those of the worker's own module, which knows them by identity.
    own, off = {} if rules is SHIPPED else {"rules": tuple(rules)}, tuple(disabled)

    def work(t: str) -> tuple:
        r = rewrite(t, level, disabled=off, enforce=enforce, **own)
        checks = None if r.checks is None else [check_row(k) for k in r.checks]
        out = r.output, [_change(c) for c in r.changes], [_change(c) for c in r.blocked], checks, r.rounds
        if not duplicates:
            return out
        return *out, ledger.duplicates(ledger.extract(t, r.regions) if r.constraints is None else r.constraints)

    schema = f"output string, changes array<{CHANGE}>, blocked array<{CHANGE}>, checks array<{CHECK}>, rounds int"
    return _columns(docs, [text], f"{schema}, duplicates array<{GROUP}>" if duplicates else schema, work)


def with_levels(docs: DataFrame, text: str = "text", levels: Iterable[str] = LEVELS) -> DataFrame:
    """Adds ``levels``: the output of each level with the ledger on, its blocked changes, and critical constraints and those kept."""
    levels = tuple(levels)

    def work(t: str) -> tuple:
        # What a prompt states doesn't depend on the level.
        found, out = scan.regions(t), []
        kept_by = ledger.Ledger(t, ledger.extract(t, found))
        for level in levels:
            r = rewrite(t, level, enforce=True, found=found, ledger=kept_by)
            told = ledger.summary(r.checks or [])
            out.append({"level": level, "output": r.output, "blocked": len(r.blocked), "critical": told["critical_total"], "kept": told["critical_preserved"]})
        return (out,)

    return _columns(docs, [text], "levels array<struct<level:string,output:string,blocked:int,critical:int,kept:int>>", work)


def with_demands(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``demands``: type, anchor and the anchor's tokens of the constraints whose wording is compared; no other scanner runs."""
    off = frozenset(ledger.TYPES) - frozenset(ledger.COMPARED)

    def work(t: str) -> tuple:
        return ([{"type": c.type, "anchor": c.anchor, "tokens": ledger.anchor_tokens(c.anchor)} for c in ledger.extract(t, exclude=off)],)

    return _columns(docs, [text], "demands array<struct<type:string,anchor:string,tokens:array<string>>>", work)


def with_constraints(docs: DataFrame, text: str = "text", exclude: Iterable[str] = ()) -> DataFrame:
    off = frozenset(exclude)
    return _columns(docs, [text], f"constraints array<{CONSTRAINT}>", lambda t: ([vars(c) for c in ledger.extract(t, exclude=off)],))


def with_checks(docs: DataFrame, original: str = "text", rewritten: str = "output") -> DataFrame:
    """Adds ``checks``: whether each constraint of ``original`` stands in ``rewritten``."""

    def work(a: str, b: str) -> tuple:
        return ([check_row(k) for k in ledger.verify(a, b, ledger.extract(a))],)

    return _columns(docs, [original, rewritten], f"checks array<{CHECK}>", work)


def with_duplicates(docs: DataFrame, text: str = "text", threshold: float = ledger.SIMILAR) -> DataFrame:
    return _columns(docs, [text], f"duplicates array<{GROUP}>", lambda t: (ledger.duplicates(ledger.extract(t), threshold),))


def with_ledger(docs: DataFrame, original: str = "text", rewritten: str = "output") -> DataFrame:
    """Adds constraints, checks and duplicates from one inventory of each prompt."""

    def work(a: str, b: str) -> tuple:
        found, checks, groups = ledger.build(a, b)
        return [vars(c) for c in found], [check_row(k) for k in checks], groups

    return _columns(docs, [original, rewritten], f"constraints array<{CONSTRAINT}>, checks array<{CHECK}>, duplicates array<{GROUP}>", work)


def with_restored(docs: DataFrame, original: str = "text", rewritten: str = "output") -> DataFrame:
    """Adds ``restored``: ``rewritten`` with the sentences of its lost critical constraints put back."""

    def work(a: str, b: str) -> tuple:
        out = b
        for k in ledger.verify(a, b, ledger.extract(a)):
            if not k.preserved and k.constraint.severity == "critical":
                out = ledger.restore(a, out, k.constraint)
        return (out,)

    return _columns(docs, [original, rewritten], "restored string", work)


def with_layout(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds how the prompt splits for a provider's cache."""

    def work(t: str) -> tuple:
        s = layout.split(t)
        return s.boundary, s.cacheable_end, s.static_prefix, s.dynamic_suffix, s.reordered_prefix, s.reordered_suffix, [m._asdict() for m in s.markers]

    schema = (
        "boundary int, cacheable_end int, static_prefix string, dynamic_suffix string, reordered_prefix string, "
        f"reordered_suffix string, markers array<{MARKER}>"
    )
    return _columns(docs, [text], schema, work)


def with_cache_ready(docs: DataFrame, provider: str, text: str = "text", ttl_id: str | None = None) -> DataFrame:
    def work(t: str) -> tuple:
        r = layout.cache_ready(t, provider, ttl_id)
        return r["text"], r["moved_lines"], r["notes"]

    return _columns(docs, [text], "cache_ready string, moved_lines array<string>, notes array<string>", work)


def with_diff(docs: DataFrame, level: str = "balanced", text: str = "text", disabled: Iterable[str] = ()) -> DataFrame:
    """Adds ``diff``: untouched text, changes and blocked changes in order, undone ones inactive."""
    off = tuple(disabled)

    def work(t: str) -> tuple:
        r = rewrite(t, level)
        return (diff_items(t, r.changes, r.blocked, off),)

    return _columns(docs, [text], f"diff array<{DIFF}>", work)


def with_model_rewrite(docs: DataFrame, squeeze: Callable[[str], str], text: str = "text", least: int = 20) -> DataFrame:
    """Adds ``output``: unprotected segments of ``least`` characters go through ``squeeze``; empty answers are ignored."""

    def work(t: str) -> tuple:
        parts = []
        for piece, kind, _, _ in scan.segments(t):
            new = squeeze(piece) if kind is None and len(piece.strip(scan.BLANK)) >= least else piece
            parts.append(new if new.strip() else piece)
        return ("".join(parts),)

    return _columns(docs, [text], "output string", work)


def with_undone(docs: DataFrame, text: str = "text", changes: str = "changes") -> DataFrame:
    """Adds ``undone``: all changes applied backwards by their offsets, which is the prompt again."""
    whole = F.aggregate(
        F.array_sort(F.transform(changes, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["original"].alias("was")))),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, c["start"] - acc["at"]), c["was"]).alias("out"), c["end"].alias("at")
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))),
    )
    return docs.withColumn("undone", whole)


__all__ = [n for n in dir() if n.startswith("with_")] + ["apply"]
