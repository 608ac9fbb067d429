"""Class hierarchies: linearisation, overrides, inherited members, scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.traverse import bfs, topological_levels
from weftgraph.storage import write_table


def c3(name: str, parents: dict[str, list[str]], memo: dict[str, list[str] | None]) -> list[str] | None:
    """C3 linearisation of one class; None where the order is inconsistent or the hierarchy cyclic."""
    if name in memo:
        return memo[name]
    memo[name] = None  # while it is open: a cycle meets None
    lines = [c3(p, parents, memo) for p in parents.get(name, [])]
    if any(x is None for x in lines):
        return None
    lists, out = [list(x) for x in lines] + [list(parents.get(name, []))], [name]
    while lists := [x for x in lists if x]:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None:
            return None
        out.append(head)
        lists = [x[1:] if x[0] == head else x for x in lists]
    memo[name] = out
    return out


def _merged(cls: str, parents: list) -> list[str] | None:
    """C3 order of a class from its parents (pos, parent, mro) in turn; None where one of them has none or they disagree."""
    if any(p.mro is None for p in parents):
        return None
    line = sorted(parents, key=lambda p: (p.pos, p.parent))
    return c3(cls, {cls: [p.parent for p in line]}, {p.parent: list(p.mro) for p in line})


def linearise(extends: DataFrame) -> DataFrame:
    """(cls, mro) from (cls, parent, pos): one row for each class; mro is null where none exists.

    Level by level: each class meets the finished orders of its own parents only, so no task holds a hierarchy."""
    e = extends.where("cls is not null and parent is not null").groupBy("cls", "parent").agg(F.min("pos").alias("pos"))
    e = write_table(e, "extends")
    nodes = e.select(F.explode(F.array("cls", "parent")).alias("id"))
    levels = write_table(topological_levels(nodes, e.select(F.col("cls").alias("src"), F.col("parent").alias("dst"))), "levels")
    merge = F.udf(_merged, "array<string>")
    at = write_table(e.join(levels, e.cls == levels.node).select("level", "cls", "parent", "pos"), "extends")
    roots = levels.join(e.select(F.col("cls").alias("node")), "node", "left_anti").select(F.col("node").alias("cls"), F.array("node").alias("mro"))
    done = [write_table(roots, "orders")]
    top = levels.agg(F.max("level")).first()[0] or 0
    for k in range(top + 1):
        known = reduce(DataFrame.unionByName, done).select(F.col("cls").alias("p"), "mro")
        met = at.where(F.col("level") == k).join(known, F.col("parent") == F.col("p"), "left")
        ready = met.groupBy("cls").agg(F.collect_list(F.struct("pos", "parent", "mro")).alias("ps"))
        done.append(write_table(ready.select("cls", merge("cls", "ps").alias("mro")), "orders"))
    cyclic = levels.where("level = -1").select(F.col("node").alias("cls"), F.lit(None).cast("array<string>").alias("mro"))
    return reduce(DataFrame.unionByName, [*done, cyclic])


def overrides(mros: DataFrame, methods: DataFrame) -> DataFrame:
    """(cls, method, winner, confidence): inherited methods that two or more ancestors define; the first in the order wins.
    A class's own method shadows; a property is no method. ``methods`` is (owner, method, kind)."""
    m = methods.where("kind != 'Property'").select("owner", "method").distinct()
    line = mros.where("mro is not null").select("cls", F.posexplode("mro").alias("pos", "owner"))
    found = line.join(m, "owner")
    g = found.groupBy("cls", "method").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.min(F.struct("pos", "owner"))["owner"].alias("winner"))
    return g.where("first > 0 and n > 1").select("cls", "method", "winner", F.lit(0.9).alias("confidence"))


def implementations(implements: DataFrame, methods: DataFrame) -> DataFrame:
    """(cls, iface, method, confidence): methods that implement an interface's; 1.0 where the arity agrees, 0.7 where it is not known;
    none where several overloads fit. ``methods`` is (owner, method, arity)."""
    a = methods.select(F.col("owner").alias("cls"), "method", F.col("arity").alias("a1"))
    b = methods.select(F.col("owner").alias("iface"), "method", F.col("arity").alias("a2"))
    both = implements.join(b, "iface").join(a, ["cls", "method"]).where("a1 is null or a2 is null or a1 = a2")
    g = both.groupBy("cls", "iface", "method").agg(F.count("*").alias("n"), F.min(F.when(F.col("a1").isNull() | F.col("a2").isNull(), 0.7).otherwise(1.0)).alias("confidence"))
    return g.where("n = 1").drop("n")


def inherited(seeds: DataFrame, extends: DataFrame, methods: DataFrame, method: str, depth: int = 10) -> DataFrame:
    """(depth, owner) of the nearest ancestors that define a method, only where there is one at that depth."""
    edges = extends.select(F.col("cls").alias("src"), F.col("parent").alias("dst"), F.lit("EXTENDS").alias("type"), F.lit(1.0).alias("confidence"))
    up = bfs(seeds, edges, depth).join(methods.where(F.col("method") == method).select(F.col("owner").alias("node")).distinct(), "node")
    near = up.groupBy("depth").agg(F.count("*").alias("n"), F.min("node").alias("owner"))
    first = near.agg(F.min(F.struct("depth", "n", "owner")).alias("r")).where("r is not null")
    return first.where("r.n = 1").select("r.depth", "r.owner")


def innermost(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """(point_id, scope_id): the narrowest scope of the same file that holds each line; ties go to the later start, then id.

    A scope is cut into dyadic blocks (level, block), at most two of a level, and of each block's scopes only the best is
    kept; a line looks up the one block of each level that it lies in. So rows grow with scopes and lines times the
    logarithm of the widest scope, never with the pairs of scopes and points."""
    a, b = F.col("start_line"), F.col("end_line")
    s = scopes.select("file", a.cast("long").alias("start_line"), b.cast("long").alias("end_line"), "scope_id").where("start_line <= end_line")
    s = s.withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin(b - a + 1)) - 1)))
    lo, hi = F.expr("-shiftright(-start_line, level)"), F.expr("shiftright(end_line + 1, level)")  # whole blocks from lo to before hi
    ends = F.array(F.when(lo % 2 != 0, lo), F.when(hi % 2 != 0, hi - 1))
    cut = s.where(lo < hi).withColumn("block", F.explode(ends)).where("block is not null")
    order = F.struct((b - a).alias("w"), (-a).alias("s"), "scope_id")
    blocks = write_table(cut.groupBy("file", "level", "block").agg(F.min(order).alias("best")), "scope-blocks")
    lines = points.select("file", F.col("line").cast("long").alias("line")).distinct()
    asked = lines.crossJoin(F.broadcast(blocks.select("level").distinct())).withColumn("block", F.expr("shiftright(line, level)"))  # at most 64 levels
    around = asked.join(blocks, ["file", "level", "block"]).groupBy("file", "line").agg(F.min("best").alias("best"))
    return points.join(around, ["file", "line"]).groupBy("point_id").agg(F.min("best")["scope_id"].alias("scope_id"))


def sections(headings: DataFrame) -> DataFrame:
    """Section end and parent for headings (doc, line, level, last_line): the end is before the next heading of the same or a
    higher level, the parent the nearest earlier heading of a lower number. Levels run from 1 to 6.

    Six running minima and maxima, one for each level, in one pass over each document's headings."""
    w = Window.partitionBy("doc").orderBy("line")
    after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    levels = range(1, 7)
    h = headings.select(
        "*", *[F.min(F.when(F.col("level") <= k, F.col("line"))).over(after).alias(f"next{k}") for k in levels],
        *[F.max(F.when(F.col("level") < k, F.col("line"))).over(before).alias(f"above{k}") for k in levels],
    )
    at = lambda name: F.coalesce(*[F.when(F.col("level") == k, F.col(f"{name}{k}")) for k in levels])
    return h.select("doc", "line", "level", F.coalesce(at("next") - 1, F.col("last_line")).alias("end_line"), at("above").alias("parent_line"))


def capped_evidence(signals: DataFrame) -> DataFrame:
    """(candidate, score): evidence weights summed and clamped to 0 to 1."""
    return signals.groupBy("candidate").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum("weight"))), 6).alias("score"))

