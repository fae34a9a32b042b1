"""Table functions for SQL: ``SELECT d.doc_id, t.* FROM corpus d, LATERAL pdf_tokens(d.content) t``.

``pdf_objects(content)``, ``pdf_tokens(content [, kinds])`` and ``pdf_operations(content [, operators])``
read a document's, or a decoded stream's, bytes; a list of kinds or operators that is constant is known
when the query is planned, and only such rows leave the function. :func:`register_callback` makes a
function of the user's own, whose columns the user states.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pagequarry.kernels import content as machine
from pagequarry.kernels import document, syntax


def columns_of(**columns: DataType) -> StructType:
    """A schema from names and types; planning runs where no session is."""
    out = StructType()
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


class _Choosing:
    """A function of bytes with an optional comma-separated choice, which planning knows."""

    columns = StructType()

    @classmethod
    def planned(cls, choice: AnalyzeArgument | None) -> AnalyzeResult:
        if choice is not None and not choice.isConstantExpression:
            raise ValueError("the list of what is wanted must be constant")
        return AnalyzeResult(schema=cls.columns)


def chosen(listed: str | None) -> frozenset[str] | None:
    return None if listed is None else frozenset(x.strip() for x in listed.split(","))


class PdfObjects:
    def eval(self, content: bytes) -> Iterator[tuple]:
        for row in document.read(content or b""):
            if row["kind"] == "object":
                yield row["seq"], row["obj"], row["gen"], row["live"], row["value"], row["stream"] is not None, row["error"]


class PdfTokens(_Choosing):
    columns = columns_of(seq=IntegerType(), kind=StringType(), text=StringType(), number=DoubleType(), offset=LongType())

    @staticmethod
    def analyze(content: AnalyzeArgument, kinds: AnalyzeArgument | None = None) -> AnalyzeResult:
        return PdfTokens.planned(kinds)

    def eval(self, content: bytes, kinds: str | None = None) -> Iterator[tuple]:
        data, at, wanted = content or b"", 0, chosen(kinds)
        seq = 0
        try:
            while t := syntax.token(data, at):
                kind, value, begin, at = t
                if kind == "keyword" and value == "stream":
                    end = data.find(b"endstream", at)
                    at = len(data) if end < 0 else end
                if wanted is None or kind in wanted:
                    text = value.hex() if isinstance(value, bytes) else None if kind == "number" else value
                    yield seq, kind, text, float(value) if kind == "number" else None, begin
                seq += 1
        except syntax.SyntaxIssue as e:
            yield seq, "error", str(e), None, e.offset


def said(operands: list) -> str:
    """Operands as JSON; the commonest, one string alone, as it stands: it has hexadecimal digits only."""
    if len(operands) == 1 and type(operands[0]) is str and operands[0].startswith("s:"):
        return f'["{operands[0]}"]'
    return json.dumps(operands)


class PdfOperations(_Choosing):
    columns = columns_of(seq=IntegerType(), operator=StringType(), operands=StringType(), offset=LongType(), error=StringType())

    @staticmethod
    def analyze(content: AnalyzeArgument, operators: AnalyzeArgument | None = None) -> AnalyzeResult:
        return PdfOperations.planned(operators)

    def eval(self, content: bytes, operators: str | None = None) -> Iterator[tuple]:
        wanted = chosen(operators)
        for seq, (op, operands, at) in enumerate(machine.operations(content or b"")):
            if op == "error":
                yield seq, None, None, at, operands[0]
            elif wanted is None or op in wanted:
                yield seq, op, said(operands), at, None


OBJECTS = columns_of(seq=IntegerType(), obj=IntegerType(), gen=IntegerType(), live=BooleanType(), value=StringType(), has_stream=BooleanType(), error=StringType())


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("pdf_objects", udtf(PdfObjects, returnType=OBJECTS, useArrow=True))
    spark.udtf.register("pdf_tokens", udtf(PdfTokens, useArrow=False))
    spark.udtf.register("pdf_operations", udtf(PdfOperations, useArrow=False))


def register_callback(spark: SparkSession, name: str, rows_of: Callable[..., Iterable[tuple]], columns: str) -> None:
    """A table function of the user's own: ``rows_of`` gets the arguments of each call and yields rows of ``columns``."""

    class Called:
        def eval(self, *arguments) -> Iterable[tuple]:
            return rows_of(*arguments)

    # called once a row for few rows each: an Arrow batch for every call would cost far more than the rows themselves
    spark.udtf.register(name, udtf(Called, returnType=columns, useArrow=False))
