"""Connected components by alternating large-star and small-star steps; strongly connected ones by trimming and colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import dealt, drop_table, write_table


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its neighbours. Minima combine map-side, so a hub is no hot task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(dealt(least), pairs.u == least.k).select("u", "v", "m")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """One row (node, component) for each endpoint; component is the least node reachable.

    Null endpoints and self-loops make no row; an empty input gives an empty result. Each round is written to the
    shared folder, so lineage stays short. Raises if ``max_rounds`` do not suffice (rounds grow with the logarithm
    of the longest path).
    """
    a, b = F.col(src), F.col(dst)
    now = write_table(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large)
        nxt = write_table(
            small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct(),
            "edges",
        )
        after = state(nxt)
        drop_table(now)
        now, done, before = nxt, after == before, after
        if done:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _spread(start: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(node, c): the least ``c`` of (node, c) among all nodes that reach a node by ``edges`` (u, v); only changes travel on."""
    known = write_table(start.select("node", "c"), label)
    fresh = known
    while True:
        sent = edges.join(dealt(fresh.select(F.col("node").alias("u"), "c")), "u").groupBy(F.col("v").alias("node")).agg(F.min("c").alias("sent"))
        better = write_table(known.join(dealt(sent), "node").where("sent < c").select("node", F.col("sent").alias("c")), f"{label}-fresh")
        if fresh is not known:
            drop_table(fresh)
        if better.isEmpty():
            drop_table(better)
            return known
        newer = write_table(known.join(dealt(better.select("node", F.col("c").alias("now"))), "node", "left").select("node", F.coalesce("now", "c").alias("c")), label)
        drop_table(known)
        known, fresh = newer, better


def _ends(edges: DataFrame) -> DataFrame:
    """Nodes that have an edge out and an edge in."""
    return edges.select(F.col("u").alias("node")).distinct().join(dealt(edges.select(F.col("v").alias("node")).distinct()), "node", "left_semi")


def strongly_connected(edges: DataFrame, src: str = "src", dst: str = "dst", trims: int = 3) -> DataFrame:
    """(node, component): nodes that reach each other; the least of them names the component. Every endpoint makes a row.

    Trimming takes away nodes that nothing enters or leaves, which are components of their own. Then every node takes the
    least node that reaches it as its colour; a node of its own colour and what reaches it backwards inside the colour
    are one component, found for all colours at once. What is left goes round again, without edges between colours.
    Rounds follow the length of paths and the nesting of components, never the number of reachable pairs.

    Null endpoints make no row; a loop alone makes its node a component; an empty table gives no rows."""
    a, b = F.col(src), F.col(dst)
    given = write_table(edges.where(a.isNotNull() & b.isNotNull()).select(a.alias("u"), b.alias("v")).distinct(), "scc-given")
    nodes = write_table(given.select(F.col("u").alias("node")).union(given.select("v")).distinct(), "scc-nodes")
    left, found = write_table(given.where("u != v"), "scc-edges"), []
    size = left.count()
    while size:
        for _ in range(trims):
            both = _ends(left)
            kept = write_table(left.join(dealt(both.select(F.col("node").alias("u"))), "u", "left_semi").join(dealt(both.select(F.col("node").alias("v"))), "v", "left_semi").select("u", "v"), "scc-edges")
            before, size = size, kept.count()
            drop_table(left)
            left = kept
            if size in (0, before):
                break
        if not size:
            break
        own = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
        colour = _spread(own.withColumn("c", F.col("node")), left, "scc-colour")
        cu, cv = colour.select(F.col("node").alias("u"), F.col("c").alias("cu")), colour.select(F.col("node").alias("v"), F.col("c").alias("cv"))
        inside = write_table(left.join(dealt(cu), "u").join(dealt(cv), "v").where("cu = cv").select("u", "v"), "scc-inside")
        # backwards from the roots: a mark can only travel inside its colour, as the edges do
        marks = F.when(F.col("node") == F.col("c"), F.lit(0)).otherwise(F.lit(1))
        reached = _spread(colour.select("node", marks.alias("c")), inside.select(F.col("v").alias("u"), F.col("u").alias("v")), "scc-back").where("c = 0").select("node")
        round_ = write_table(colour.join(dealt(reached), "node").select("node", F.col("c").alias("component")), "scc-found")
        found.append(round_)
        done = round_.select("node")
        rest = write_table(inside.join(dealt(done.select(F.col("node").alias("u"))), "u", "left_anti").join(dealt(done.select(F.col("node").alias("v"))), "v", "left_anti").select("u", "v"), "scc-edges")
        for older in (left, colour, inside):
            drop_table(older)
        left, size = rest, rest.count()
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    cyclic = reduce(DataFrame.unionByName, found)
    return nodes.join(dealt(cyclic), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct (src, dst) between components, by the edges (src, dst) of their members: a graph without cycles."""
    a, b = components.select(F.col("node").alias("src"), F.col("component").alias("cs")), components.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
    return edges.select("src", "dst").join(dealt(a), "src").join(dealt(b), "dst").where("cs != cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()


def finalisation_order(edges: DataFrame) -> DataFrame:
    """(node, component, level): modules of an import cycle share a component; a component's level is above all that it imports (leaves: 0)."""
    from weftgraph.operators.traverse import topological_levels

    components = write_table(strongly_connected(edges), "order-components")
    dag = write_table(condensation(edges, components), "order-dag")
    levels = topological_levels(components.select(F.col("component").alias("id")).distinct(), dag)
    return components.join(dealt(levels.select(F.col("node").alias("component"), "level")), "component").select("node", "component", "level")
