"""Symbols, imports, calls, routes and headings from source files: a registry of parsers run on the executors.

Python files are parsed with ``ast``; other languages by line patterns; Markdown by headings and links. The parse gives
rows, and all resolution (imports, calls, heritage) is joins over them.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.schema import node_id

FACTS = "path string, kind string, name string, owner string, target string, line int, end_line int, level int, exported boolean"
Fact = tuple  # path, kind, name, owner, target, line, end_line, level, exported

_SYMBOL = re.compile(r"^\s*(export\s+)?(?:default\s+)?(?:public\s+|private\s+|static\s+|async\s+|abstract\s+)*(class|interface|function|func|fn|def|trait|struct|enum)\s+(\w+)(?:.*?\b(?:extends|implements)\s+(\w+))?")
_IMPORT = re.compile(r"""^\s*(?:import\b.*?from\s+|import\s+|(?:const|let|var)\b.*?\brequire\(|use\s+|#include\s+)["'<]?([\w./@:\\-]+)""")
_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_LINK = re.compile(r"\[[^\]]*\]\(([^)\s]+)\)")
_ROUTE = re.compile(r"""\b(?:app|router|server)\.(get|post|put|delete|patch)\(\s*["'`]([^"'`]+)""")
_FETCH = re.compile(r"""\b(?:fetch|axios(?:\.\w+)?)\(\s*(["'`][^"'`]+["'`])""")
_WORDS = frozenset("if for while switch return catch function def class new await typeof super print sizeof".split())


def parse_python(path: str, text: str) -> Iterator[Fact]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return

    def visit(node: ast.AST, owner: str) -> Iterator[Fact]:
        for child in ast.iter_child_nodes(node):
            line, end = getattr(child, "lineno", 0), getattr(child, "end_lineno", 0)
            inner = owner
            if isinstance(child, ast.ClassDef):
                yield path, "Class", child.name, owner, None, line, end, 0, not child.name.startswith("_")
                for k, b in enumerate(child.bases):
                    if name := getattr(b, "id", getattr(b, "attr", None)):
                        yield path, "extends", child.name, owner, name, line, end, k, False
                inner = child.name
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "Method" if owner and owner[:1].isupper() else "Function"
                yield path, kind, child.name, owner, None, line, end, len(child.args.args), not child.name.startswith("_")
                inner = f"{owner}.{child.name}" if owner else child.name
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield path, "import", a.asname or a.name, owner, a.name, line, end, 0, False
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    yield path, "import", a.asname or a.name, owner, f"{'.' * child.level}{child.module or ''}", line, end, child.level, False
            elif isinstance(child, ast.Call):
                if name := getattr(child.func, "id", getattr(child.func, "attr", None)):
                    yield path, "call", name, owner, None, line, end, len(child.args), False
            yield from visit(child, inner)

    yield from visit(tree, "")


def parse_lines(path: str, text: str) -> Iterator[Fact]:
    owner = ""
    for n, line in enumerate(text.split("\n"), 1):
        if m := _SYMBOL.match(line):
            kind = {"class": "Class", "interface": "Interface", "trait": "Trait", "struct": "Struct", "enum": "Enum"}.get(m[2], "Function")
            yield path, kind, m[3], owner, None, n, n, 0, bool(m[1])
            if m[4]:
                yield path, "extends", m[3], owner, m[4], n, n, 0, False
            owner = m[3]
        elif m := _IMPORT.match(line):
            yield path, "import", m[1].rsplit("/", 1)[-1], owner, m[1], n, n, 0, False
        else:
            for m in _CALL.finditer(line):
                if m[1] not in _WORDS:
                    yield path, "call", m[1], owner, None, n, n, 0, False
        for m in _ROUTE.finditer(line):
            yield path, "route", m[1].upper(), owner, m[2], n, n, 0, False
        for m in _FETCH.finditer(line):
            yield path, "fetch", owner, owner, m[1].strip("\"'"), n, n, 0, False


def parse_markdown(path: str, text: str) -> Iterator[Fact]:
    lines, fenced = text.split("\n"), False
    for n, line in enumerate(lines, 1):
        fenced ^= line.lstrip().startswith("```")
        if not fenced and (m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)):
            yield path, "Section", m[2], "", None, n, len(lines), len(m[1]), False
        for m in _LINK.finditer(line):
            if not re.match(r"[a-z]+:|#|//", m[1]):
                yield path, "link", "", "", m[1].split("#")[0], n, n, 0, False


PARSERS: dict[str, Callable[[str, str], Iterator[Fact]]] = {"py": parse_python, "md": parse_markdown, "mdx": parse_markdown} | dict.fromkeys(
    ["js", "jsx", "ts", "tsx", "java", "kt", "cs", "go", "rs", "php", "rb", "swift", "dart", "c", "h", "cpp", "hpp"], parse_lines
)


def parse(files: DataFrame, parsers: dict[str, Callable[[str, str], Iterator[Fact]]] | None = None) -> DataFrame:
    """Facts of files (path, content); files without a parser or content make none. More parsers may be given by ending."""
    known = parsers or PARSERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("owner", pa.string()), ("target", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("level", pa.int32()), ("exported", pa.bool_())]
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                find = known.get((path or "").rsplit(".", 1)[-1].lower())
                rows = list(find(path, text)) if find and text else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    return files.select("path", "content").mapInArrow(run, FACTS)


def symbols(facts: DataFrame) -> DataFrame:
    """Symbol nodes (id, label, name, filePath, startLine, endLine, isExported, owner)."""
    kinds = ["Class", "Interface", "Trait", "Struct", "Enum", "Function", "Method", "Section"]
    s = facts.where(F.col("kind").isin(kinds))
    key = F.concat_ws(":", "path", F.when(F.col("owner") != "", F.concat_ws(".", "owner", "name")).otherwise(F.col("name")))
    return s.select(F.concat(F.col("kind"), F.lit(":"), key).alias("id"), F.col("kind").alias("label"), "name", F.col("path").alias("filePath"), F.col("line").alias("startLine"), F.col("end_line").alias("endLine"), F.col("exported").alias("isExported"), "owner")


def resolve_imports(facts: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS edges (src, dst) between file ids: a module path matches a file whose path ends with it, the shortest one."""
    want = facts.where("kind = 'import'").select("path", F.regexp_replace(F.regexp_replace("target", r"^[./\\]+", ""), r"[.\\:]+", "/").alias("module")).where("module != ''").distinct()
    stem = files.select(F.col("path").alias("file"), F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z]+$", ""), "/(?:__init__|index)$", "").alias("stem"))
    parts = F.split("stem", "/")
    ends = stem.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "/"))).alias("module"))
    hit = want.join(ends, "module").where("path != file")
    best = hit.groupBy("path", "module").agg(F.min(F.struct(F.length("file").alias("n"), "file"))["file"].alias("file"))
    return best.select(node_id("File", F.col("path")).alias("src"), node_id("File", F.col("file")).alias("dst")).distinct()


def resolve_calls(facts: DataFrame, imports: DataFrame) -> DataFrame:
    """CALLS edges (src, dst, confidence): same file 0.95, imported file 0.9, any file 0.5; all candidates of the best tier."""
    s = symbols(facts).where(F.col("label").isin("Function", "Method", "Class"))
    calls = facts.where("kind = 'call'").select("path", "owner", "name").distinct()
    c = calls.join(s.select("name", F.col("id").alias("dst"), F.col("filePath").alias("file")), "name")
    imp = imports.select(F.col("src").alias("i"), F.col("dst").alias("j"))
    c = c.join(imp, (node_id("File", F.col("path")) == F.col("i")) & (node_id("File", F.col("file")) == F.col("j")), "left")
    confidence = F.when(F.col("path") == F.col("file"), 0.95).when(F.col("i").isNotNull(), 0.9).otherwise(0.5)
    c = c.withColumn("confidence", confidence)
    best = c.groupBy("path", "owner", "name").agg(F.max("confidence").alias("confidence"))
    src = F.when(F.col("owner") != "", F.concat_ws(":", "path", "owner")).otherwise(F.concat(F.lit("File:"), F.col("path")))
    return c.join(best, ["path", "owner", "name", "confidence"]).select(src.alias("src"), "dst", "confidence").distinct()
