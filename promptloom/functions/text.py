"""Text functions as column expressions; none of them leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rules import RULES
from . import patterns
from .dialect import for_java, needles


def estimated_tokens(text: Column) -> Column:
    """Mean of words over 0.75 and characters over 4, rounded half up, at least 1; 0 for an empty text."""
    words, chars = F.regexp_count(text, F.lit(r"\S+")), F.length(text)
    by_both = F.floor((words / F.lit(0.75) + chars / F.lit(4.0)) / 2 + 0.5)
    size = F.when(words == 0, F.floor(chars / F.lit(4.0) + 0.5)).otherwise(by_both)
    return F.when(F.coalesce(chars, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), size)).cast("long")


def canonical(text: Column) -> Column:
    """Lower-cased, ASCII quotes and dashes, equivalents replaced, fillers gone."""
    def replaced(out: Column, pattern: str, new: str) -> Column:
        # Tried only where a word that all matches hold stands; the array of one is evaluated once.
        def one(o: Column) -> Column:
            some = reduce(Column.__or__, [F.contains(o, F.lit(w)) for w in dict.fromkeys(needles(pattern))])
            return F.when(some, F.regexp_replace(o, for_java(pattern), new)).otherwise(o)

        return F.get(F.transform(F.array(out), one), F.lit(0))

    out = F.lower(F.translate(text, "‘’‛“”‟–—   ", "'''\"\"\"--   "))
    for name, _, _, pattern, _, new in RULES:
        if name.startswith("sub."):
            out = replaced(out, pattern, "us$1" if new.startswith("use:") else new)
    for _, pattern, _ in patterns.FILLERS:
        out = replaced(out, pattern, " ")
    return out


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(canonical(text), F.lit(patterns.TOKEN), F.lit(0))


def occurrences(within: Column, sought: Column) -> Column:
    """At how many places ``sought`` stands contiguously in ``within``, overlaps counted."""
    spare = F.size(within) - F.size(sought)
    starts = F.when((F.size(sought) > 0) & (spare >= 0), F.sequence(F.lit(1), spare + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(within, i, F.size(sought)) == sought))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token lists as sets; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.size(F.array_union(a, b)))


def batch(text: Column) -> Column:
    """Prompts separated by lines of three dashes, trimmed, empty ones dropped."""
    even = F.regexp_replace(text, "\r\n", "\n")
    parts = F.split(even, r"(?m)^[ \t\r\f]*---[ \t\r\f]*$", -1)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def preview(text: Column, length: int = 60) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= length, flat).otherwise(F.concat(F.substring(flat, 1, length - 1), F.lit("…")))


def variable_kind(text: Column) -> Column:
    by = {label: for_java(p, f) for label, p, f in patterns.DYNAMIC}
    name = F.trim(F.regexp_replace(text, r"[^A-Za-z0-9_ .-]", " "))
    return F.when(name.rlike(by["date name"]), "date").when(name.rlike(by["id name"]), "identifier").otherwise("variable")


def count_matches(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(for_java(pattern, flags)))


def imported(path: Column, content: Column) -> Column:
    """The ``input`` string of an exported .json file, else the content."""
    said = F.get_json_object(content, "$.input")
    is_text = F.schema_of_variant(F.try_parse_json(content)).contains("input: STRING")
    return F.when(F.lower(path).endswith(".json") & is_text & said.isNotNull(), said).otherwise(content)


def exported(form: str, source: Column, output: Column, level: Column) -> Column:
    """A prompt as a .txt, .md or .json file."""
    if form == "json":
        return F.concat(F.to_json(F.struct(source.alias("input"), output.alias("output"), level.alias("level")), {"pretty": "true"}), F.lit("\n"))
    return F.when(F.coalesce(output, F.lit("")) != "", output).otherwise(source)


# Kinds of exported files. Fixed values.
MIME = {"txt": "text/plain", "md": "text/markdown", "json": "application/json"}


def export_name(form: str, stem: str = "prompt") -> str:
    """The file name of an export; KeyError for an unknown form."""
    return f"{stem}.{form}" if MIME[form] else stem


def is_batch(text: Column) -> Column:
    """Whether a text holds more than one prompt."""
    return F.size(batch(text)) > 1
