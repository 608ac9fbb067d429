"""Graph patterns as joins: expansions, optional and negated patterns, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand(nodes: DataFrame, edges: DataFrame, direction: str = "out", types: list[str] | None = None, where: Column | None = None, optional: bool = False) -> DataFrame:
    """(node, other, type, confidence, direction) for each edge at a node; "both" lists a self-loop once.

    ``where`` is a predicate on the edge; an optional expansion keeps it inside the join, so that nodes without a fitting
    edge stay with nulls."""
    e = edges if types is None else edges.where(F.col("type").isin(types))
    if where is not None:
        e = e.where(where)
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("other"), "type", "confidence", F.lit("out").alias("direction"))
    into = e.select(F.col("dst").alias("at"), F.col("src").alias("other"), "type", "confidence", F.lit("in").alias("direction"))
    sides = {"out": out, "in": into}
    hops = sides[direction] if direction in sides else out.unionByName(into.where("at != other"))
    ids = nodes.select(F.col("id").alias("node"))
    return ids.join(hops, ids.node == hops.at, "left" if optional else "inner").drop("at")


def chain(edges: DataFrame, *types: str) -> DataFrame:
    """(n0, n1, ... nk) of directed paths whose edges have these types in turn."""
    path: DataFrame | None = None
    for k, kind in enumerate(types):
        hop = edges.where(F.col("type") == kind).select(F.col("src").alias(f"n{k}"), F.col("dst").alias(f"n{k + 1}"))
        path = hop if path is None else path.join(hop, f"n{k}")
    return path


def having(nodes: DataFrame, edges: DataFrame, kind: str, direction: str = "out", negate: bool = False) -> DataFrame:
    """Nodes with (or without) an edge of a type: a semi or anti join."""
    end = "src" if direction == "out" else "dst"
    ends = edges.where(F.col("type") == kind).select(F.col(end).alias("at"))
    return nodes.join(ends, nodes.id == ends.at, "left_anti" if negate else "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) by one union and one aggregation."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def hub_pairs(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(a, hub, b): nodes that meet in the target of two relation types."""
    a = edges.where(F.col("type") == left).select(F.col("src").alias("a"), F.col("dst").alias("hub"))
    b = edges.where(F.col("type") == right).select(F.col("src").alias("b"), F.col("dst").alias("hub"))
    return a.join(b, "hub").select("a", "hub", "b")


def overlapping(ranges: DataFrame, spans: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of ``ranges`` (key, r_start, r_end) and ``spans`` (key, s_start, s_end) that overlap, ends inclusive.

    Both sides are cut into bins of ``width``, so that the join is on (key, bin) and not on the key alone; a pair is kept
    in the first bin that both touch."""

    def binned(df: DataFrame, a: str, b: str) -> DataFrame:
        lo, hi = F.floor(F.col(a) / width), F.floor(F.col(b) / width)
        return df.where(F.col(a) <= F.col(b)).withColumn("bin", F.explode(F.sequence(lo, hi)))

    both = binned(ranges, "r_start", "r_end").join(binned(spans, "s_start", "s_end"), [key, "bin"])
    first = F.floor(F.greatest("r_start", "s_start") / width)
    return both.where((F.col("r_start") <= F.col("s_end")) & (F.col("s_start") <= F.col("r_end")) & (F.col("bin") == first)).drop("bin")


def resolve_tiers(requests: DataFrame, candidates: DataFrame, on: list[str], tiers: list[Column], confidences: list[float]) -> DataFrame:
    """Candidates of the best tier for each request: all that share it, with the tier's confidence.

    ``tiers`` are conditions over a joined row, best first; rows of no tier go."""
    joined = requests.join(candidates, on)
    tier = F.coalesce(*[F.when(c, F.lit(k)) for k, c in enumerate(tiers)])
    ranked = joined.withColumn("tier", tier).where("tier is not null")
    best = ranked.groupBy("request_id").agg(F.min("tier").alias("best"))
    confidence = F.element_at(F.array(*[F.lit(c) for c in confidences]), F.col("tier") + 1)
    return ranked.join(best, "request_id").where("tier = best").drop("best").withColumn("confidence", confidence)


def tier_counts(requests: DataFrame, candidates: DataFrame, on: list[str], tiers: list[Column], confidences: list[float], name: str) -> DataFrame:
    """(request_id, tier, n, first, confidence): how many candidates ``resolve_tiers`` gives each request, and the least of them by ``name``.

    Requests that agree in all other columns have the same candidates, and so do candidates for a tier: only these classes
    meet, never single requests and candidates. Of repeated request ids the best tier over all their rows counts."""
    asks, kinds = [c for c in requests.columns if c != "request_id"], [c for c in candidates.columns if c != name]
    classes = requests.select(*asks).distinct().withColumn("request_id", F.struct(*asks))
    groups = candidates.groupBy(*kinds).agg(F.count("*").alias("n"), F.min(name).alias("first"))
    hit = resolve_tiers(classes, groups, on, tiers, confidences).groupBy("request_id", "tier", "confidence").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    own = requests.select(F.col("request_id").alias("request"), F.struct(*asks).alias("asked")).join(hit, F.col("asked").eqNullSafe(F.col("request_id")))
    by_tier = own.groupBy("request", "tier").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("confidence").alias("confidence"))
    best = by_tier.groupBy(F.col("request").alias("request_id")).agg(F.min(F.struct("tier", "n", "first", "confidence")).alias("r"))
    return best.select("request_id", "r.*")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: a minimum over structs, which combines before the shuffle, in place of a window."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.min(ranked).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])
