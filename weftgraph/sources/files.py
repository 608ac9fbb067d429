"""Files, diffs, registries and configuration as DataFrames; graph tables written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import quote
from weftgraph.operators.pattern import first_of

#: Folders and endings that a walk skips (fixed values).
IGNORED_FOLDERS = [".git", "node_modules", "dist", "build", "target", "vendor", "__pycache__", ".venv", "coverage"]
MAX_FILE_BYTES = 512 * 1024
CHUNK_BYTES = 20 << 20


def walk(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES, with_content: bool = True) -> DataFrame:
    """(path, size, content) of the files below ``root``, ignored folders and large files left out, unreadable files dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    skip = "/(?:" + "|".join(map(quote, IGNORED_FOLDERS)) + ")/"
    kept = files.where((F.col("length") <= max_bytes) & ~F.rlike("path", F.lit(skip)))
    cols = [F.col("path"), F.col("length").alias("size")]
    return kept.select(*cols, F.try_validate_utf8(F.col("content").cast("string")).alias("content")) if with_content else kept.select(*cols)


def folder_edges(paths: DataFrame) -> DataFrame:
    """CONTAINS edges (src, dst) of the folder tree above each path."""
    from weftgraph.functions.routes import path_prefixes

    up = paths.select(F.explode(F.arrays_zip(path_prefixes(F.col("path")).alias("p"), F.slice(path_prefixes(F.col("path")), 2, 1 << 30).alias("c"))).alias("e"))
    return up.select(F.col("e.p").alias("src"), F.col("e.c").alias("dst")).where("dst is not null").distinct()


def diff_hunks(lines: DataFrame) -> DataFrame:
    """(diff, filePath, startLine, endLine) of the new side of unified diffs given as (diff, n, line); pure deletions are dropped.

    The file name of a hunk is the last one above it in its diff."""
    w = Window.partitionBy("diff").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.startswith("line", F.lit("+++ ")), F.regexp_extract("line", r"^\+\+\+ (?:b/)?([^\t]*)", 1))
    h = lines.withColumn("filePath", F.last(name, ignorenulls=True).over(w)).where(F.startswith("line", F.lit("@@ ")))
    start = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("long")
    count = F.coalesce(F.nullif(F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1), F.lit("")).cast("long"), F.lit(1))
    return h.select("diff", "filePath", start.alias("startLine"), (start + count - 1).alias("endLine")).where("endLine >= startLine and filePath != '/dev/null'")


def merge_config(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """(key, value): the value of the source of highest priority for each key."""
    every = reduce(DataFrame.unionByName, [d.select("key", "value", F.lit(p).alias("priority")) for p, d in sources])
    return first_of(every, ["key"], [-F.col("priority"), F.col("value")]).select("key", "value")


def config_map(config: DataFrame) -> DataFrame:
    """One row with all entries as a map; configuration is small by nature."""
    return config.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("config"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, int]:
    """Write nodes by label and edges by their end labels; edges without both ends are skipped and counted.

    The jobs that write also count, so that nodes and edges are made once. (Where an executor is lost while edges are dealt
    out, those it dealt again count twice among the skipped; what is written is right.)"""
    some, given, kept = Observation(), Observation(), Observation()
    nodes.observe(some, F.count("*").alias("n")).write.partitionBy("label").mode("overwrite").parquet(f"{path}/nodes")
    ends = nodes.select("id", "label")
    a = ends.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    b = ends.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    placed = edges.observe(given, F.count("*").alias("n")).join(a, "src").join(b, "dst").observe(kept, F.count("*").alias("n"))
    placed.write.partitionBy("src_label", "dst_label").mode("overwrite").parquet(f"{path}/edges")
    n, written = some.get["n"], kept.get["n"]
    # without nodes Spark need not look at the edges for the join
    return {"nodes": n, "edges": written, "skipped": (given.get["n"] if n else edges.count()) - written}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def first_wins(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The first row of each key in insertion order."""
    return first_of(rows, [key], [F.col(order)])


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key."""
    return table.join(changes.select(key), key, "left_anti").select(table.columns).unionByName(changes.select(table.columns))


def delete_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a file, and the edges at them, removed."""
    gone = nodes.where(F.col("filePath") == path).select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.where(~F.col("filePath").eqNullSafe(F.lit(path))), left.select(edges.columns)


def ndjson(nodes: DataFrame, edges: DataFrame):
    """JSON lines of all nodes, then all edges, fetched partition by partition."""
    for kind, df in (("node", nodes), ("edge", edges)):
        for r in df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct("*").alias("data"))).alias("j")).toLocalIterator():
            yield r.j


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A bounded report of the first rows as a Markdown table."""
    rows = [[str("" if v is None else v).replace("|", "\\|").replace("\n", " ") for v in r] for r in df.limit(limit).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def grep(files: DataFrame, pattern: str, limit: int = 200, width: int = 200) -> DataFrame:
    """(path, line, text): lines that match, case-insensitive, cut to ``width``, the first ``limit`` by path and line."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("k", "t"))
    hit = lines.where(F.rlike("t", F.lit(f"(?i){pattern}")))
    return hit.select("path", (F.col("k") + 1).alias("line"), F.substring("t", 1, width).alias("text")).orderBy("path", "line").limit(limit)
