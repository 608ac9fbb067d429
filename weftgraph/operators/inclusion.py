"""Textual inclusion of copybooks: programs with every COPY statement replaced by the lines that it names.

Level by level: only the lines that include something are joined to the copybook's lines. A line's place in the result is
an array - the line number, then the number within what it includes, and so on - and arrays sort as nested text does,
so no level renumbers the one before it. Every line keeps the file and line that it comes from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import write_table

#: Levels of inclusion beyond which a statement stays as it is (a fixed value).
MAX_DEPTH = 10
STATEMENT = r"(?i)^\s*COPY\s+[\"']?([A-Z0-9_-]+)[\"']?(?:\s+REPLACING\s+(.*?))?\s*\.\s*$"
PAIR = r"(?i)==(.*?)==\s+BY\s+==(.*?)=="


def included_name(text: Column) -> Column:
    """Upper-cased name that a COPY statement includes; null for other lines."""
    name = F.upper(F.regexp_extract(text, STATEMENT, 1))
    return F.when(name != "", name)


def replacements(text: Column) -> Column:
    """(from, to) pairs of a COPY statement's REPLACING phrase, in order."""
    phrase = F.regexp_extract(text, STATEMENT, 2)
    pairs = F.arrays_zip(F.regexp_extract_all(phrase, F.lit(PAIR), F.lit(1)).alias("from"), F.regexp_extract_all(phrase, F.lit(PAIR), F.lit(2)).alias("to"))
    return F.filter(pairs, lambda p: p["from"] != "")


def replaced(text: Column, pairs: Column) -> Column:
    """``text`` with each pair's first part replaced by its second, pair after pair."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p["from"], p["to"]))


def expand_copies(programs: DataFrame, copybooks: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(program, place, text, source, line, depth, note) of ``programs`` (program, line, text) and ``copybooks`` (name, line, text).

    ``place`` orders a program's lines; ``source`` and ``line`` say where a line comes from. A statement that cannot be
    followed stays, unchanged, as a line of its own with a note: 'missing' (no such copybook), 'circular' (the copybook is being
    included already) or 'too deep'. An inner statement's replacements come first, then those around it. Names meet
    regardless of case; of copybooks of one name the lines are all taken. Null names, lines and texts make no line."""
    books = copybooks.select(F.upper("name").alias("book"), F.col("line").cast("int").alias("at"), F.col("text").alias("own")).dropna()
    books = write_table(books, "copybooks")
    names = books.select(F.col("book").alias("known")).distinct()
    start = programs.select("program", F.col("line").cast("int"), "text").dropna()
    level = start.select(
        "program", F.array("line").alias("place"), "text", F.col("program").cast("string").alias("source"), "line", F.lit(0).alias("depth"),
        F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<from:string,to:string>>").alias("pairs"),
    )
    done = []
    for depth in range(max_depth + 1):
        marked = level.withColumn("name", included_name(F.col("text"))).join(names, F.col("name") == F.col("known"), "left")
        circular = F.array_contains("stack", F.col("name"))
        note = F.when(F.col("known").isNull() & F.col("name").isNotNull(), "missing").when(circular, "circular").when(F.col("name").isNotNull() & F.lit(depth >= max_depth), "too deep")
        marked = write_table(marked.withColumn("note", note), "copy-level")
        stays = F.col("name").isNull() | F.col("note").isNotNull()
        done.append(marked.where(stays).select("program", "place", F.when(F.col("note").isNull(), replaced(F.col("text"), F.col("pairs"))).otherwise(F.col("text")).alias("text"), "source", "line", "depth", "note"))
        open_ = marked.where(~stays)
        if depth == max_depth or open_.isEmpty():
            break
        inner = open_.join(books, F.col("name") == F.col("book"))
        level = inner.select(
            "program", F.concat("place", F.array("at")).alias("place"), F.col("own").alias("text"), F.col("name").alias("source"), F.col("at").alias("line"), F.lit(depth + 1).alias("depth"),
            F.concat("stack", F.array("name")).alias("stack"), F.concat(replacements(F.col("text")), F.col("pairs")).alias("pairs"),
        )
    return reduce(DataFrame.unionByName, done)


def copy_cycles(copybooks: DataFrame) -> DataFrame:
    """(name, component): copybooks that include each other, or themselves; the least name stands for the cycle."""
    from weftgraph.operators.compose import strongly_connected

    links = copybooks.select(F.upper("name").alias("src"), included_name(F.col("text")).alias("dst")).dropna()
    return strongly_connected(links).select(F.col("node").alias("name"), "component")
