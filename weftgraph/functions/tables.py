"""Table functions for SQL: ``register(spark)``, then ``SELECT ... FROM t, LATERAL weft_chunks(t.text, 1200, 120)`` or
``SELECT * FROM weft_top(TABLE(t) PARTITION BY k ORDER BY (s DESC), 3)``.

A function over a table sees each partition's rows in order as a stream and holds none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StructType


@udtf(returnType="chunk int, start int, stop int")
class Chunks:
    """Overlapping pieces of a text, by characters: a text that fits is one piece; null makes no row."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
        if text is None:
            return
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be less than the size")
        at = k = 0
        while True:
            yield k, at, min(at + size, len(text))
            if at + size >= len(text):
                return
            at, k = at + size - overlap, k + 1


@udtf(returnType="position int, word string")
class Words:
    """Words of a text between white space, with their positions from 0."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split())


def _with(table: AnalyzeArgument, name: str) -> AnalyzeResult:
    return AnalyzeResult(schema=StructType([*table.dataType.fields]).add(name, IntegerType()))


@udtf
class Top:
    """The first rows of each partition of a table, with their rank from 1."""

    def __init__(self) -> None:
        self.seen = 0

    @staticmethod
    def analyze(row: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        return _with(row, "rank")

    def eval(self, row: Row, limit: int) -> Iterator[tuple]:
        self.seen += 1
        if self.seen <= limit:
            yield (*row, self.seen)


@udtf
class Sessions:
    """Rows of each partition of a table (ordered by ``column``) with the number of their session: a gap above ``gap`` begins a new one."""

    def __init__(self) -> None:
        self.before, self.number = None, 0

    @staticmethod
    def analyze(row: AnalyzeArgument, column: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        return _with(row, "session")

    def eval(self, row: Row, column: str, gap: float) -> Iterator[tuple]:
        now = row[column]
        if self.before is not None and now is not None and now - self.before > gap:
            self.number += 1
        self.before = now if now is not None else self.before
        yield (*row, self.number)


FUNCTIONS = {"weft_chunks": Chunks, "weft_words": Words, "weft_top": Top, "weft_sessions": Sessions}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
