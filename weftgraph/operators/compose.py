"""Composed graph tools: processes, cycles, value resolution along callers, rules, contracts from facts."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.functions import routes, text
from weftgraph.operators import components, pattern, traverse
from weftgraph.operators.search import ranked
from weftgraph.storage import drop_table, write_table


def entry_points(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """(id, score) of the best entry points: callees / (callers + 1), twice that if exported, times the name's factor; test
    files and nodes without callees are left out. ``nodes`` is (id, name, filePath, isExported)."""
    good = edges.where("type = 'CALLS' and confidence >= 0.5")
    d = pattern.degrees(good).where("n_out > 0")
    n = nodes.where(~text.is_entry_test_path(F.col("filePath")))
    score = F.col("n_out") / (F.col("n_in") + 1) * F.when(F.col("isExported"), 2.0).otherwise(1.0) * text.entry_name_score(F.col("name"))
    score = score * F.when(text.is_utility_path(F.col("filePath")), 0.5).otherwise(1.0)
    return d.join(n, d.node == n.id).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def detect_processes(nodes: DataFrame, edges: DataFrame, members: DataFrame, max_processes: int | None = None, min_steps: int = 3, max_nodes: int = 10) -> tuple[DataFrame, DataFrame]:
    """Processes (id, label, entry, terminal, stepCount, processType) and their steps (process, node, step).

    Entry points, path enumeration, sub-path removal, then the longest paths up to a limit that follows the number of
    nodes (a tenth of them, 20 to 300). A process over two or more communities is ``cross_community``."""
    if max_processes is None:
        max_processes = max(20, min(300, round(nodes.where("label != 'File'").count() / 10)))
    starts = entry_points(nodes, edges)
    paths = traverse.drop_subpaths(traverse.enumerate_paths(starts, edges.where("type = 'CALLS'"), max_nodes=max_nodes)).where(F.size("path") >= min_steps)
    top = paths.orderBy(F.desc(F.size("path")), "entry", "terminal").limit(max_processes)
    p = ranked(top, [F.desc(F.size("path")), F.col("entry"), F.col("terminal")], start=0)
    names = nodes.select(F.col("id").alias("n"), "name")
    p = p.join(names.withColumnsRenamed({"n": "entry", "name": "a"}), "entry").join(names.withColumnsRenamed({"n": "terminal", "name": "b"}), "terminal")
    p = p.withColumn("id", F.concat_ws("_", F.lit("proc"), F.col("rank").cast("string"), text.sanitize_id(F.col("a"))))
    steps = p.select(F.col("id").alias("process"), F.posexplode("path").alias("k", "node")).select("process", "node", (F.col("k") + 1).alias("step"))
    spread = steps.join(members, "node", "left").groupBy("process").agg(F.countDistinct("community").alias("c"))
    kind = F.when(F.col("c") > 1, "cross_community").otherwise("intra_community")
    out = p.join(spread, p.id == spread.process).select("id", F.concat(text.capitalize(F.col("a")), F.lit(" → "), text.capitalize(F.col("b"))).alias("label"), "entry", "terminal", F.size("path").alias("stepCount"), kind.alias("processType"))
    return out, steps


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles: nodes that reach each other; the least of them names the component."""
    found = components.strongly_connected(edges)
    several = found.groupBy("component").count().where("count > 1").select("component")
    loops = edges.where("src = dst").select(F.col("src").alias("component")).distinct()
    return found.join(several.union(loops).distinct(), "component", "left_semi").select("node", "component")


def bubble_up(sinks: DataFrame, calls: DataFrame, values: DataFrame, max_depth: int = 5, max_callers: int = 20) -> DataFrame:
    """(sink, value, confidence, depth): the best value that a sink's node or one of its callers holds; nearer callers first,
    then higher confidence, then the lesser value. ``sinks`` is (sink, node), ``values`` (node, value, confidence).

    The first ``max_callers`` callers of a node, by name, are followed. Each level is a written table of the sinks that no
    nearer level has settled, so a sink stops climbing where a value is found."""
    first = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    up = calls.select("src", "dst").distinct().withColumn("k", first).where(F.col("k") <= max_callers).select(F.col("dst").alias("node"), F.col("src").alias("caller"))
    up, values = write_table(up, "callers"), write_table(values.select("node", "value", "confidence"), "values")
    level, found = write_table(sinks.select("sink", "node").distinct(), "bubble"), []
    for depth in range(max_depth + 1):
        here = level.join(values, "node").groupBy("sink").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "value")).alias("b"))
        found.append(write_table(here.select("sink", "b.value", (-F.col("b.c")).alias("confidence"), F.lit(depth).alias("depth")), "bubbled"))
        open_ = level.join(found[-1].select("sink"), "sink", "left_anti")
        older, level = level, write_table(open_.join(up, "node").select("sink", F.col("caller").alias("node")).distinct(), "bubble")
        drop_table(older)
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def apply_rule(nodes: DataFrame, edges: DataFrame, rule: str | dict) -> DataFrame:
    """Nodes that a graph rule emits: (id, label, source).

    A rule names a label and predicates on properties (``{"equals" | "matches" | "contains": value}``), steps along relation
    types, and an id template over the variables ``start`` and ``end`` (``${start.name}``)."""
    r = json.loads(rule) if isinstance(rule, str) else rule

    def select(df: DataFrame, spec: dict) -> DataFrame:
        for name, test in spec.get("where", {}).items():
            (op, value), c = next(iter(test.items())), F.col(name)
            df = df.where({"equals": c == value, "matches": F.rlike(c.cast("string"), F.lit(str(value))), "contains": F.contains(c.cast("string"), F.lit(str(value)))}[op])
        return df.where(F.col("label") == spec["label"]) if "label" in spec else df

    cols = nodes.columns
    found = select(nodes, r["start"]).select(F.struct(*cols).alias("start"), F.col("id").alias("at"))
    for step in r.get("steps", []):
        a, b = ("src", "dst") if step.get("direction", "out") == "out" else ("dst", "src")
        hop = edges.where(F.col("type").isin(step["types"])).select(F.col(a).alias("at"), F.col(b).alias("next"))
        found = found.join(hop, "at").select("start", F.col("next").alias("at"))
    end = select(nodes, r.get("end", {})).select(F.struct(*cols).alias("end"), F.col("id").alias("at"))
    found = found.join(end, "at")
    out = F.lit(r["emit"]["id"])
    for var in ("start", "end"):
        for c in cols:
            out = F.replace(out, F.lit(f"${{{var}.{c}}}"), F.coalesce(F.col(f"{var}.{c}").cast("string"), F.lit("")))
    return found.select(out.alias("id"), F.lit(r["emit"]["label"]).alias("label"), F.col("start.id").alias("source")).distinct()


def http_contracts(facts: DataFrame, repo: str) -> DataFrame:
    """Contracts (repo, contractId, role, symbolUid, filePath, confidence) of the routes and fetches that parsing found."""
    side = facts.where("kind in ('route', 'fetch')")
    method = F.when(F.col("kind") == "route", F.col("name")).otherwise(F.lit("*"))
    path = F.when(F.col("kind") == "route", routes.provider_path(F.col("target"))).otherwise(routes.consumer_path(F.col("target")))
    role = F.when(F.col("kind") == "route", "provider").otherwise("consumer")
    return side.select(
        F.lit(repo).alias("repo"), F.concat_ws("::", F.lit("http"), method, path).alias("contractId"), role.alias("role"),
        F.concat_ws(":", "path", "owner").alias("symbolUid"), F.col("path").alias("filePath"), F.lit(None).cast("string").alias("service"), F.lit(0.9).alias("confidence"),
    ).distinct()


def resolve_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst, confidence) of relative Markdown links (path, target) that name a known file."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    joined = F.concat_ws("/", F.when(F.startswith("target", F.lit("/")), F.lit("")).otherwise(folder), F.regexp_replace("target", "^/", ""))
    # "a/./b" and "a/b/../c" by folding the segments
    folded = F.aggregate(
        F.split(joined, "/"), F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin(".", ""), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    want = links.select("path", F.array_join(folded, "/").alias("dst"))
    known = paths.select(F.regexp_replace("path", "^/", "").alias("dst"))
    return want.join(known, "dst", "left_semi").select(F.col("path").alias("src"), "dst", F.lit(0.8).alias("confidence")).distinct()


def either_column(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``left`` and ``right`` where the key equals any of the right's columns: a union of equi joins, distinct."""
    return reduce(DataFrame.unionByName, [left.join(right, left[key] == right[c]) for c in columns]).distinct()


def parity(runs: DataFrame) -> DataFrame:
    """(language, n, agree, rate) of shadow runs (language, old, new)."""
    same = F.col("old").eqNullSafe(F.col("new"))
    g = runs.groupBy("language").agg(F.count("*").alias("n"), F.sum(same.cast("int")).alias("agree"))
    return g.withColumn("rate", F.round(F.col("agree") / F.col("n"), 6))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Indexed repositories or contracts of a JSON registry: one row for each entry of a document or a list."""
    return spark.read.option("multiLine", "true").json(path)


def is_current(registry: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, current): whether the indexed commit is the head (``heads`` is (repo, head))."""
    return heads.join(registry.select("repo", "commit"), "repo", "left").select("repo", F.coalesce(F.col("commit") == F.col("head"), F.lit(False)).alias("current"))
