"""Traversals: breadth-first impact, neighbourhoods, bounded paths, path enumeration, topological levels.

Each level is a join of the frontier with the edges, written to the shared folder, so lineage stays one level deep.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import bounded_broadcast, dealt, drop_table, write_table


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, direction: str = "out", types: list[str] | None = None, min_confidence: float = 0.0, skip: DataFrame | None = None) -> DataFrame:
    """(node, depth, type, via, confidence) of the nodes reached from ``seeds`` (column id), the seeds themselves left out.

    A node gets its least depth; of several edges to it the one of highest confidence, then least type, then least
    source. Nodes in ``skip`` (column id) are neither reported nor walked through. Depth 0 means 3."""
    max_depth = max_depth or 3
    e = edges if types is None else edges.where(F.col("type").isin(types))
    e = e.where(F.col("confidence") >= min_confidence)
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    hops = e.select(F.col(a).alias("via"), F.col(b).alias("node"), "type", "confidence")
    if skip is not None:
        hops = hops.join(skip.select(F.col("id").alias("node")), "node", "left_anti")
    hops = write_table(hops, "hops")
    frontier = write_table(seeds.select(F.col("id").alias("node")).distinct(), "level")
    levels, visited = [], [frontier]
    for depth in range(1, max_depth + 1):
        reached = hops.join(bounded_broadcast(frontier.select(F.col("node").alias("via"))), "via")
        fresh = reached.join(reduce(DataFrame.unionByName, [v.select("node") for v in visited]), "node", "left_anti")
        best = fresh.groupBy("node").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "type", "via")).alias("r"))
        level = best.select("node", F.lit(depth).alias("depth"), "r.type", "r.via", (-F.col("r.c")).alias("confidence"))
        frontier = write_table(level, "level")
        levels.append(frontier)
        visited.append(frontier)
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Signed depths (upstream negative, 0 the seeds; the nearest wins, downstream at ties) and the induced edges."""
    down = bfs(seeds, edges, depth, "out").select("node", "depth")
    up = bfs(seeds, edges, depth, "in").select("node", (-F.col("depth")).alias("depth"))
    every = down.unionByName(up).unionByName(seeds.select(F.col("id").alias("node"), F.lit(0).alias("depth")))
    order = F.struct(F.abs("depth").alias("far"), (-F.col("depth")).alias("sign"))
    near = every.groupBy("node").agg((-F.min(order)["sign"]).alias("depth"))
    inside = edges.join(near.select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dst")), "dst", "left_semi")
    return near, inside


def enumerate_paths(entries: DataFrame, edges: DataFrame, max_nodes: int = 10, branching: int = 4, min_confidence: float = 0.5) -> DataFrame:
    """(entry, path) of maximal simple paths from ``entries`` (column id): at most ``branching`` callees of a node, in order
    of step, then id; a path ends where no callee is new or it has ``max_nodes`` nodes.

    Paths are looked at in the order of a queue - shorter ones first, then by the places of their nodes among the callees -
    and an entry stops at 3 x ``branching`` ended paths. As ended paths of a round come before all longer ones, an entry
    that has enough of them is dropped before the next round."""
    most = 3 * branching
    good = edges.where((F.col("confidence") >= min_confidence) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.min("step").alias("step"))
    w = Window.partitionBy("src").orderBy(F.col("step").asc_nulls_last(), "dst")
    hops = write_table(good.withColumn("k", F.row_number().over(w)).where(F.col("k") <= branching).select("src", "dst", "k"), "callees")
    live = write_table(entries.select(F.col("id").alias("entry"), F.array("id").alias("path"), F.array().cast("array<int>").alias("places")).distinct(), "paths")
    done = []
    for _ in range(max_nodes - 1):
        tip = live.withColumn("src", F.element_at("path", -1))
        grown = tip.join(hops, "src").where(~F.array_contains("path", F.col("dst")))
        grown = write_table(grown.select("entry", F.array_append("path", F.col("dst")).alias("path"), F.array_append("places", F.col("k")).alias("places")), "paths")
        ended = live.join(grown.select(F.expr("slice(path, 1, size(path) - 1)").alias("path"), "entry").distinct(), ["entry", "path"], "left_anti")
        done.append(write_table(ended.select("entry", "path", "places"), "ended"))
        full = reduce(DataFrame.unionByName, done).groupBy("entry").count().where(F.col("count") >= most).select("entry")
        live = write_table(grown.join(full, "entry", "left_anti"), "paths")
        drop_table(grown)
        if live.isEmpty():
            break
    every = reduce(DataFrame.unionByName, [*done, live])
    queue = Window.partitionBy("entry").orderBy(F.size("path"), "places", "path")
    return every.withColumn("at", F.row_number().over(queue)).where(F.col("at") <= most).select("entry", "path")


def drop_subpaths(paths: DataFrame) -> DataFrame:
    """Paths that are no contiguous part of another path of the same entry, then the longest for each (entry, end)."""
    text = paths.withColumn("t", F.concat(F.lit(">"), F.array_join("path", ">"), F.lit(">")))
    # an inner part starts at some node of the longer path: meet on (entry, first node) and test the text
    longer = text.select(F.col("entry").alias("e"), F.col("t").alias("t2"), F.size("path").alias("n2"), F.explode(F.array_distinct("path")).alias("first"))
    own = text.withColumn("first", F.element_at("path", 1))
    hit = (own.entry == longer.e) & (own["first"] == longer["first"]) & (longer.n2 > F.size(own.path)) & F.contains(longer.t2, own.t)
    kept = own.join(longer, hit, "left_anti")
    order = F.struct((-F.size("path")).alias("n"), F.col("t"), F.col("path"))
    best = kept.groupBy("entry", F.element_at("path", -1).alias("terminal")).agg(F.min(order).alias("b"))
    return best.select("entry", "terminal", F.col("b.path").alias("path"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): leaves (nothing left that they depend on) first; nodes on or above a cycle get level -1."""
    left = write_table(edges.where("src != dst").select("src", "dst").distinct(), "deps")
    rest = write_table(nodes.select(F.col("id").alias("node")).distinct(), "rest")
    out = []
    for level in count():
        free = write_table(rest.join(dealt(left.select(F.col("src").alias("node"))), "node", "left_anti").withColumn("level", F.lit(level)), "free")
        if free.isEmpty():
            break
        out.append(free)
        older, oldest = left, rest
        left = write_table(left.join(dealt(free.select(F.col("node").alias("dst"))), "dst", "left_anti").select("src", "dst"), "deps")
        rest = write_table(rest.join(dealt(free.select("node")), "node", "left_anti"), "rest")
        drop_table(older)
        drop_table(oldest)
    return reduce(DataFrame.unionByName, [*out, rest.withColumn("level", F.lit(-1))])


def closure(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """All (src, dst) that a directed path joins, by repeated doubling; for include and re-export graphs, whose closures are small."""
    known = write_table(edges.select("src", "dst").where("src != dst").distinct(), "closure")
    for _ in range(max_rounds):
        a, b = known.select("src", F.col("dst").alias("mid")), known.select(F.col("src").alias("mid"), "dst")
        more = write_table(known.unionByName(a.join(b, "mid").where("src != dst").select("src", "dst")).distinct(), "closure")
        done = more.count() == known.count()
        drop_table(known)
        known = more
        if done:
            return known
    raise RuntimeError("closure did not settle")


def impact_risk(direct: Column, processes: Column, modules: Column, total: Column) -> Column:
    """Risk bands of an impact analysis."""
    return (
        F.when((direct >= 30) | (processes >= 5) | (modules >= 5) | (total >= 200), "CRITICAL")
        .when((direct >= 15) | (processes >= 3) | (modules >= 3) | (total >= 100), "HIGH")
        .when((direct >= 5) | (total >= 30), "MEDIUM")
        .otherwise("LOW")
    )
