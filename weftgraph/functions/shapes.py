"""Texts of code symbols: what a matcher of routes fits, embedding texts, chunks along statements."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import text as text_functions


def per_text(kind: T.DataType, f: Callable[[str], object]):
    """``f`` of each text (null: null) as an Arrow function."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if t.as_py() is None else f(t.as_py()) for t in b], arrow)

    return apply


# ---- middleware ----------------------------------------------------------------------------------------------------


def matches_route(matcher: Column, route: Column) -> Column:
    """Whether a project middleware's matcher fits a route: ``/:path*`` is a prefix, a pattern with a group an expression, else equality."""
    prefix = F.regexp_replace(matcher, r"/:path\*$", "")
    under = (route == prefix) | F.startswith(route, F.concat(prefix, F.lit("/")))
    return F.when(prefix != matcher, under).when(F.contains(matcher, F.lit("(")), F.rlike(route, F.concat(F.lit("^"), matcher, F.lit("$")))).otherwise(route == matcher)


# ---- embedding texts and code chunks ------------------------------------------------------------------------------------


def embedding_header(node: Column, description_limit: int = 150) -> Column:
    """Label and name, repository, path, export flag and a short description of a node, a line each; nulls make no line."""
    return F.concat_ws(
        "\n",
        F.concat_ws(": ", node["label"], node["name"]),
        F.when(node["repoId"] != "", F.concat(F.lit("Repo: "), node["repoId"])),
        F.concat(F.lit("Path: "), node["filePath"]),
        F.concat(F.lit("Export: "), node["isExported"].cast("string")),
        F.when(node["description"] != "", text_functions.short_description(node["description"], description_limit)),
    )


def embedding_text(node: Column, body: Column, tail: Column | None = None) -> Column:
    """Header, the end of the chunk before (if any), an empty line and the cleaned body."""
    before = F.lit(None).cast("string") if tail is None else F.when(tail != "", F.concat(F.lit("[preceding context]: ..."), text_functions.clean_content(tail)))
    return F.concat_ws("\n", embedding_header(node), before, F.lit(""), text_functions.clean_content(body))


def unit_chunks(text: str, size: int = 1200, overlap: int = 120) -> list[dict[str, object]]:
    """Chunks of a function or class along its statements: (chunk, start, end).

    Statements are the top-level lines of the body, by bracket depth or indentation. As many as fit go into a chunk; the
    last ones that fit into ``overlap`` begin the next; a statement that alone is too long is cut by characters."""
    if len(text) <= size:
        return [{"chunk": 0, "start": 0, "end": len(text)}]
    units = statements(text)
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(units):
        start, j = (0 if i == 0 else units[i][0]), i
        end_of = lambda k: len(text) if k == len(units) - 1 else units[k][1]
        while j + 1 < len(units) and end_of(j + 1) - start <= size:
            j += 1
        if end_of(j) - start > size:
            at = start
            while True:
                out.append((at, min(at + size, end_of(i))))
                if at + size >= end_of(i):
                    break
                at += size - overlap
            i += 1
            continue
        out.append((start, end_of(j)))
        if j == len(units) - 1:
            break
        k = j
        while k > i and units[j][1] - units[k - 1][0] <= overlap:
            k -= 1
        i = k if i < k <= j and units[j][1] - units[k][0] <= overlap else j + 1
    return [{"chunk": k, "start": a, "end": b} for k, (a, b) in enumerate(out)]


def statements(text: str) -> list[tuple[int, int]]:
    """(start, end) of the top-level statements of the body that the first line opens."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    braces = "{" in lines[0][1] or (len(lines) > 1 and lines[1][1].strip() == "{")
    out: list[list[int]] = []
    depth, level = 0, None
    for start, line in lines[1:] if len(lines) > 1 else lines:
        body = line.strip()
        indent = len(line) - len(line.lstrip())
        if body:
            if level is None:
                level = indent
            fresh = depth <= 0 if braces else indent <= level
            if fresh and body[0] not in "})]" or not out:
                out.append([start + indent, start + len(line.rstrip())])
            else:
                out[-1][1] = start + len(line.rstrip())
            depth += sum(body.count(c) for c in "{([") - sum(body.count(c) for c in "})]")
    return [(a, b) for a, b in out] or [(0, len(text))]


CHUNKS = T.ArrayType(T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def code_chunks(source: Column) -> Column:
    return per_text(CHUNKS, unit_chunks)(source)
