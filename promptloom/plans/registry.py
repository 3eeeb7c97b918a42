"""Registered queries and their SQL, and what several of them state in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns
from ..operators.rules import RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return keep


def value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(map(value, x)) + "]"
    return f"{x}::DOUBLE" if isinstance(x, float) else str(x)


def rows_sql(rows) -> str:
    return ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)


# Estimated tokens of {0}.
TOKENS = (
    "CAST(CASE WHEN COALESCE(length({0}), 0) = 0 THEN 0 "
    "WHEN len(regexp_extract_all({0}, '\\S+')) = 0 THEN greatest(1, floor(length({0}) / 4.0::DOUBLE + 0.5)) "
    "ELSE greatest(1, floor((len(regexp_extract_all({0}, '\\S+')) / 0.75::DOUBLE + length({0}) / 4.0::DOUBLE) / 2 + 0.5)) END AS BIGINT)"
)


def canonical_sql(column: str) -> str:
    out = f"lower(translate({column}, '‘’‛“”‟–—' || chr(160) || chr(8199) || chr(8239), '''''''\"\"\"--   '))"
    for name, _, _, pattern, _, new in RULES:
        if name.startswith("sub."):
            new = "us\\1" if new.startswith("use:") else new
            out = f"regexp_replace({out}, {value(pattern)}, {value(new)}, 'g')"
    for _, pattern, _ in patterns.FILLERS:
        out = f"regexp_replace({out}, {value(pattern)}, ' ', 'g')"
    return out


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all({canonical_sql(column)}, {value(patterns.TOKEN)})"
