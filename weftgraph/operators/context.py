"""Views around symbols: context, implementations, enrichment of search hits, service scope, sink lists and summaries.

Node frames are (id, label, name, filePath, ...), edge frames (src, dst, type, confidence, step). Every view is one plan
of joins over all symbols asked for, so a list of symbols costs no more passes than one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import search

#: Relation types that a context shows (fixed values).
CONTEXT_TYPES = ["CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "HAS_METHOD", "HAS_PROPERTY", "METHOD_OVERRIDES", "OVERRIDES", "METHOD_IMPLEMENTS", "ACCESSES"]
CONSTRUCTOR_TYPES = ["CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "ACCESSES"]
FILE_TYPES = ["CALLS", "IMPORTS"]


def numbered(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key in that order, with their number k from 1."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= limit)


def context(symbols: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 30) -> DataFrame:
    """(symbol, direction, type, other, name, filePath, label): what refers to each symbol (column id) and what it refers to.

    A class or interface also has the callers of its constructors and of the file that defines it, each (type, caller)
    once, direct ones first. At most ``limit`` rows for each symbol, direction and source of rows, in order of type and id."""
    ids = symbols.select(F.col("id").alias("symbol")).distinct()
    known = edges.where(F.col("type").isin(CONTEXT_TYPES))

    def rows(df: DataFrame, direction: str, source: int) -> DataFrame:
        out = df.select("symbol", F.lit(direction).alias("direction"), F.lit(source).alias("source"), "type", "other").distinct()
        return numbered(out, ["symbol"], [F.col("type"), F.col("other")], limit).drop("k")

    into = known.join(ids, F.col("dst") == F.col("symbol")).select("symbol", "type", F.col("src").alias("other"))
    out = known.join(ids, F.col("src") == F.col("symbol")).select("symbol", "type", F.col("dst").alias("other"))
    labels = nodes.select("id", "label")
    classes = ids.join(labels, F.col("symbol") == F.col("id")).where(F.col("label").isin("Class", "Interface")).select("symbol")
    made = edges.where("type = 'HAS_METHOD'").select(F.col("src").alias("symbol"), F.col("dst").alias("via"))
    made = made.join(classes, "symbol").join(labels.where("label = 'Constructor'").select(F.col("id").alias("via")), "via")
    held = edges.where("type = 'DEFINES'").select(F.col("dst").alias("symbol"), F.col("src").alias("via")).join(classes, "symbol")

    def through(via: DataFrame, types: list[str]) -> DataFrame:
        calls = edges.where(F.col("type").isin(types)).select("type", F.col("src").alias("other"), F.col("dst").alias("via"))
        return via.join(calls, "via").select("symbol", "type", "other")

    every = [rows(into, "in", 0), rows(through(made, CONSTRUCTOR_TYPES), "in", 1), rows(through(held, FILE_TYPES), "in", 2), rows(out, "out", 0)]
    refs = reduce(DataFrame.unionByName, every).groupBy("symbol", "direction", "type", "other").agg(F.min("source").alias("source"))
    facts = nodes.select(F.col("id").alias("other"), "name", "filePath", "label")
    return refs.join(facts, "other", "left").select("symbol", "direction", "type", "other", "name", "filePath", "label")


def participation(symbols: DataFrame, processes: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, process, label, step, stepCount) of the processes (id, heuristicLabel, stepCount) that symbols are steps of."""
    steps = edges.where("type = 'STEP_IN_PROCESS'").select(F.col("src").alias("symbol"), F.col("dst").alias("process"), "step")
    p = processes.select(F.col("id").alias("process"), F.col("heuristicLabel").alias("label"), "stepCount")
    return steps.join(symbols.select(F.col("id").alias("symbol")).distinct(), "symbol").join(p, "process").select("symbol", "process", "label", "step", "stepCount")


def implementations_of(interfaces: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(interface, relation, id, name, of): classes that implement an interface (column id), methods that implement its methods, and children."""
    ids = interfaces.select(F.col("id").alias("interface")).distinct()
    e = edges.select("src", "dst", "type")

    def direct(kind: str, name: str) -> DataFrame:
        hit = e.where(F.col("type") == kind).join(ids, F.col("dst") == F.col("interface"))
        return hit.select("interface", F.lit(name).alias("relation"), F.col("src").alias("id"), F.lit(None).cast("string").alias("of"))

    own = e.where("type = 'HAS_METHOD'").join(ids, F.col("src") == F.col("interface")).select("interface", F.col("dst").alias("method"))
    methods = e.where("type = 'METHOD_IMPLEMENTS'").select(F.col("src").alias("id"), F.col("dst").alias("method")).join(own, "method")
    names = nodes.select("id", "name")
    named = methods.join(names.withColumnsRenamed({"id": "method", "name": "of"}), "method", "left").select("interface", F.lit("method").alias("relation"), "id", "of")
    every = direct("IMPLEMENTS", "class").unionByName(named).unionByName(direct("EXTENDS", "extender"))
    return every.distinct().join(names, "id", "left").select("interface", "relation", "id", "name", "of")


def enrich_hits(hits: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """(id, direction, type, other): at most ``limit`` edges into and out of each search hit (column id), in order of type and neighbour."""
    ids = hits.select("id").distinct()
    out = ids.join(edges.select(F.col("src").alias("id"), "type", F.col("dst").alias("other"), F.lit("out").alias("direction")), "id")
    into = ids.join(edges.select(F.col("dst").alias("id"), "type", F.col("src").alias("other"), F.lit("in").alias("direction")), "id")
    top = numbered(out.unionByName(into).distinct(), ["id", "direction"], [F.col("type"), F.col("other")], limit)
    return top.select("id", "direction", "type", "other")


def augment(pattern: str, files: DataFrame, nodes: DataFrame, edges: DataFrame, communities: DataFrame, processes: DataFrame, top_files: int = 5, per_file: int = 3, shown: int = 3) -> DataFrame:
    """(id, name, filePath, callers, callees, flows, cohesion) of the symbols that go with a search pattern, most cohesive first.

    The best files by BM25 give symbols whose name holds the pattern's first word, ``per_file`` of each and as many as there
    are files in all; each shows ``shown`` callers and callees. ``files`` is (filePath, text), ``communities`` (id, cohesion)."""
    word = pattern.split()[0] if pattern.split() and len(pattern) >= 3 else None
    # without a pattern no file fits
    best = search.bm25(files, pattern if word else "", "filePath", limit=2 * top_files).limit(top_files).select(F.col("id").alias("filePath"), "score")
    fits = nodes.join(best, "filePath").where(F.contains("name", F.lit(word or "")))
    some = numbered(fits.select("id", "name", "filePath", "score"), ["filePath"], [F.col("id")], per_file)
    some = some.orderBy(F.desc("score"), "filePath", "k").limit(top_files).drop("k", "score")
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("n"))
    calls = edges.where("type = 'CALLS'")

    def side(mine: str, other: str, name: str) -> DataFrame:
        met = some.select("id").join(calls.select(F.col(mine).alias("id"), F.col(other).alias("other")).distinct(), "id").join(names, "other")
        first = numbered(met, ["id"], [F.col("n"), F.col("other")], shown)
        return first.groupBy("id").agg(F.array_sort(F.collect_list("n")).alias(name))

    flows = participation(some, processes, edges)
    flows = flows.groupBy(F.col("symbol").alias("id")).agg(F.array_sort(F.collect_list(F.format_string("%s (step %s/%s)", "label", F.col("step").cast("string"), F.col("stepCount").cast("string")))).alias("flows"))
    member = edges.where("type = 'MEMBER_OF'").select(F.col("src").alias("id"), F.col("dst").alias("c"))
    cohesion = member.join(communities.select(F.col("id").alias("c"), "cohesion"), "c").groupBy("id").agg(F.max("cohesion").alias("cohesion"))
    out = some.join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "callees"), "id", "left").join(flows, "id", "left").join(cohesion, "id", "left")
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("callers", "callees", "flows")]
    return out.select("id", "name", "filePath", *lists, F.coalesce("cohesion", F.lit(0.0)).alias("cohesion")).orderBy(F.desc("cohesion"), "id")


def service_scope(nodes: DataFrame, edges: DataFrame, service: str) -> DataFrame:
    """Nodes of a service: its own, the tools it handles, the transports it uses or serves, its business groups and its own service node."""
    own = nodes.where(F.col("repoId") == service)
    ends = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), "type")
    handled = nodes.where("label = 'Tool'").join(ends.where("type = 'HANDLES_TOOL'").select("id"), "id", "left_semi")
    moved = nodes.where("label = 'Transport'").join(ends.where("type in ('TRANSPORTS_TO', 'SERVES')").select("id"), "id", "left_semi")
    named = nodes.where(((F.col("label") == "BusinessGroup") & F.startswith("id", F.lit(f"{service}:"))) | ((F.col("label") == "ServiceNode") & (F.col("id") == service)))
    return own.unionByName(handled).unionByName(moved).unionByName(named).distinct()


def list_sinks(sinks: DataFrame, status: str | None = None, kind: str | None = None, category: str | None = None, limit: int = 50) -> DataFrame:
    """Detected sinks, least confident first (ties by id), at most 200; ``status`` is ``resolved`` or ``unresolved``."""
    low = (F.col("confidence") < 0.5) | F.col("resolvedVia").isin("unresolvable", "")
    out = sinks
    if status == "unresolved":
        out = out.where(low)
    if status == "resolved":
        out = out.where(F.col("confidence") >= 0.5)
    if kind is not None:
        out = out.where(F.col("sinkType") == kind)
    if category is not None:
        out = out.where(F.col("sinkCategory") == category)
    return out.orderBy("confidence", "id").limit(min(limit, 200))


def unresolved_by(sinks: DataFrame, column: str, default: str, limit: int | None = None) -> DataFrame:
    """(value, n): how many unresolved sinks each reason or pattern has, most first (ties by value)."""
    open_ = sinks.where(F.coalesce("resolutionStatus", F.lit("unresolved")) != "resolved")
    out = open_.groupBy(F.coalesce(F.col(column), F.lit(default)).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if limit is None else out.limit(limit)


def seed_counts(seeds: DataFrame, kind: Column) -> DataFrame:
    """(kind, n) of seed nodes, each node once."""
    return seeds.select("id", kind.alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("n"))


def dependencies(poms: DataFrame, libraries: DataFrame) -> DataFrame:
    """(src, dst, version) DEPENDS_ON from build files (service, text): artefacts that a known library (artifactId, id) has; a repeated one keeps the greatest version."""
    block = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1)))
    d = poms.select("service", block.alias("b"))
    field = lambda name: F.trim(F.regexp_extract("b", rf"(?s)<{name}>(.*?)</{name}>", 1))
    found = d.select(F.col("service").alias("src"), field("artifactId").alias("artifactId"), F.nullif(field("version"), F.lit("")).alias("version")).where("artifactId != ''")
    return found.join(libraries.select("artifactId", F.col("id").alias("dst")), "artifactId").groupBy("src", "dst").agg(F.max("version").alias("version"))


def overlay_manual(sinks: DataFrame, manual: DataFrame) -> DataFrame:
    """Sinks with the values that people set by hand (id, value) over those found: those get confidence 1 and ``resolvedVia`` manual."""
    m = manual.groupBy("id").agg(F.max("value").alias("by_hand"))
    hand = F.col("by_hand").isNotNull()
    joined = sinks.join(m, "id", "left")
    changed = {"value": F.coalesce("by_hand", "value"), "confidence": F.when(hand, 1.0).otherwise(F.col("confidence")), "resolvedVia": F.when(hand, "manual").otherwise(F.col("resolvedVia"))}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in sinks.columns])


def capped(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows, each with ``truncated``: whether there were more."""
    more = df.limit(limit + 1).agg((F.count("*") > limit).alias("truncated"))
    return df.orderBy(*order).limit(limit).join(F.broadcast(more))  # one row
