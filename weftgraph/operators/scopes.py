"""Lexical scopes by one ordered sweep: parents, invariants, and the innermost scope at a position.

Scopes (and positions) of a file are sorted once by where they begin; a stream over that order keeps the scopes that are
still open as a stack, so each row meets only the scopes around it, never all scopes of its file. Memory is the depth of
the nesting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES = ["start_line", "start_col", "end_line", "end_col"]
TREE = "file string, scope_id long, parent long, depth int, first_child boolean, crosses long"


def _swept(df: DataFrame, order: list, run: Callable, schema: str) -> DataFrame:
    """``run`` over the rows of each file in ``order``; a file's rows lie in one partition, one after the other."""
    return df.repartition("file").sortWithinPartitions("file", *order).mapInArrow(run, schema)


class _Open:
    """The open scopes of the file that the stream is in, outermost first: (start, end, id)."""

    def __init__(self) -> None:
        self.file, self.stack = object(), []

    def at(self, file: str | None, start: tuple[int, int]) -> None:
        """Go on to a row that begins at ``start``: scopes that end before it are closed."""
        if file != self.file:
            self.file, self.stack = file, []
        while self.stack and self.stack[-1][1] < start:
            self.stack.pop()
        if any(s[1] < start for s in self.stack):  # only where scopes cross
            self.stack = [s for s in self.stack if s[1] >= start]


def scope_tree(scopes: DataFrame) -> DataFrame:
    """(file, scope_id, parent, depth, first_child, crosses) of scopes (file, scope_id, start_line, start_col, end_line, end_col).

    The parent is the scope of the same file that holds the scope and begins last before it; of equal ranges the least id
    is outermost. ``crosses`` is the number of open scopes that end inside the scope, which a well-formed file never has.
    Rows with a null id or place make no row, nor do scopes that end before they begin; a null file is a file of its own."""
    given = scopes.select("file", F.col("scope_id").cast("long"), *[F.col(c).cast("int") for c in PLACES]).dropna(subset=["scope_id", *PLACES])
    given = given.where("(end_line, end_col) >= (start_line, start_col)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parents = _Open(), set()
        for b in batches:
            out = []
            for file, scope, *at in zip(*(c.to_pylist() for c in b.columns)):
                start, end = tuple(at[:2]), tuple(at[2:])
                if file != now.file:
                    parents = set()
                now.at(file, start)
                around = [s for s in now.stack if s[1] >= end]
                parent = around[-1][2] if around else None
                out.append((file, scope, parent, len(around), parent not in parents, len(now.stack) - len(around)))
                parents.add(parent)
                now.stack.append((start, end, scope))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()))], names=["file", "scope_id", "parent", "depth", "first_child", "crosses"])

    order = [F.col("start_line"), F.col("start_col"), F.col("end_line").desc(), F.col("end_col").desc(), F.col("scope_id")]
    return _swept(given, order, run, TREE)


def scope_faults(scopes: DataFrame) -> DataFrame:
    """(file, fault, n): how often a file breaks a rule of scope trees.

    Rules: ids are unique; a file has one outermost scope (rows (…, kind) other than 'Module' need a parent); a parent holds
    more than its child; siblings do not overlap."""
    given = scopes.select("file", F.col("scope_id").cast("long"), "kind", *PLACES)
    tree = scope_tree(given)
    kinds = given.select("file", "scope_id", "kind", *PLACES)
    twice = given.groupBy("file", "scope_id").count().where("count > 1").groupBy("file").agg(F.count("*").alias("n")).withColumn("fault", F.lit("duplicate id"))
    met = tree.join(kinds.select(F.col("file").alias("f"), F.col("scope_id").alias("s"), "kind", *PLACES), (F.col("file").eqNullSafe(F.col("f"))) & (F.col("scope_id") == F.col("s"))).drop("f", "s")
    roots = met.where("parent is null and kind != 'Module'").groupBy("file").agg(F.count("*").alias("n")).withColumn("fault", F.lit("no parent"))
    outer = kinds.select(F.col("file").alias("f"), F.col("scope_id").alias("p"), *[F.col(c).alias(f"p_{c}") for c in PLACES])
    equal = met.join(outer, F.col("file").eqNullSafe(F.col("f")) & (F.col("parent") == F.col("p"))).where(" and ".join(f"{c} = p_{c}" for c in PLACES))
    equal = equal.groupBy("file").agg(F.count("*").alias("n")).withColumn("fault", F.lit("parent not larger"))
    # siblings in order of their starts: each must begin after all earlier ones have ended
    before = F.max(F.struct("end_line", "end_col")).over(Window.partitionBy("file", "parent").orderBy(*PLACES[:2], F.desc("end_line"), F.desc("end_col"), "scope_id").rowsBetween(Window.unboundedPreceding, -1))
    overlap = met.withColumn("before", before).where("before >= struct(start_line, start_col)").groupBy("file").agg(F.count("*").alias("n")).withColumn("fault", F.lit("siblings overlap"))
    return twice.unionByName(roots).unionByName(equal).unionByName(overlap).select("file", "fault", "n")


def innermost_at(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """(file, point_id, scope_id): the scope around each point (file, point_id, line, col) that begins last; of equal ranges the greatest id. Points outside all scopes have null."""
    s = scopes.select("file", F.col("scope_id").cast("long").alias("id"), *[F.col(c).cast("int") for c in PLACES], F.lit(0).alias("point")).dropna(subset=["id", *PLACES])
    s = s.where("(end_line, end_col) >= (start_line, start_col)")
    p = points.select("file", F.col("point_id").cast("long").alias("id"), F.col("line").cast("int").alias("start_line"), F.col("col").cast("int").alias("start_col")).dropna(subset=["id", "start_line", "start_col"])
    p = p.withColumns({"end_line": F.col("start_line"), "end_col": F.col("start_col"), "point": F.lit(1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Open()
        for b in batches:
            out = []
            for file, row, *at, point in zip(*(c.to_pylist() for c in b.columns)):
                now.at(file, tuple(at[:2]))
                if point:
                    out.append((file, row, now.stack[-1][2] if now.stack else None))
                else:
                    now.stack.append((tuple(at[:2]), tuple(at[2:]), row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["file", "point_id", "scope_id"])

    order = [F.col("start_line"), F.col("start_col"), F.col("point"), F.col("end_line").desc(), F.col("end_col").desc(), F.col("id")]
    return _swept(s.unionByName(p), order, run, "file string, point_id long, scope_id long")
