"""Table functions for Spark SQL: a prompt's segments, sentences, constraints and batch as rows.

``register`` makes them known to a session, for ``LATERAL`` use::

    SELECT p.id, s.* FROM prompts p, LATERAL segments(p.text) s
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators import ledger, scan


def _result(text: AnalyzeArgument, *columns: str) -> AnalyzeResult:
    """Columns of strings, but for offsets and places."""
    if not isinstance(text.dataType, StringType):
        raise ValueError("the text must be a string")
    schema = StructType()
    for name in columns:
        schema = schema.add(name, IntegerType() if name in ("start", "end", "place") else StringType())
    return AnalyzeResult(schema)


class Segments:
    """(text, kind, start, end): pieces that join to the text, protected ones with their kind."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _result(text, "text", "kind", "start", "end")

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from scan.segments(text or "")


class Sentences:
    """(text, start, end)."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _result(text, "text", "start", "end")

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from scan.sentences(text or "")


class Constraints:
    """(id, type, severity, anchor, start, end, label) of the types that aren't in a comma-separated list."""

    @staticmethod
    def analyze(text: AnalyzeArgument, exclude: AnalyzeArgument | None = None) -> AnalyzeResult:
        if exclude is not None and not exclude.isConstantExpression:
            raise ValueError("the types to leave out must be a constant")
        return _result(text, "id", "type", "severity", "anchor", "start", "end", "label")

    def eval(self, text: str | None, exclude: str | None = None) -> Iterator[tuple]:
        off = frozenset((exclude or "").replace(" ", "").split(",")) - {""}
        for c in ledger.extract(text or "", exclude=off):
            yield c.id, c.type, c.severity, c.anchor, c.start, c.end, c.label


class Batch:
    """(place, prompt): the prompts of a text, which lines of three dashes separate."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _result(text, "place", "prompt")

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from enumerate(scan.batch(text or ""))


FUNCTIONS = {"segments": Segments, "prompt_sentences": Sentences, "constraints": Constraints, "batch": Batch}


def register(spark: SparkSession) -> None:
    """Make the table functions known to ``spark``, under the names in ``FUNCTIONS``."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
