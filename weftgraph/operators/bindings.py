"""Names that modules export: own definitions, named re-exports and wildcards, followed to where they are defined.

A semi-naive fixpoint: each round joins only the bindings that the round before found, so a chain of n modules takes n
rounds over ever fewer rows and a cycle ends as soon as it brings nothing new. The closure of modules is never listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import drop_table, write_table

KEY = ["module", "name", "origin", "origin_name"]


def export_bindings(own: DataFrame, named: DataFrame, wild: DataFrame) -> DataFrame:
    """Every (module, name, origin, origin_name, hops): all definitions that a name of a module may stand for.

    ``own`` is (module, name), ``named`` (module, name, source, source_name) for ``export {source_name as name} from
    source``, ``wild`` (module, source) for ``export * from source``. What a module defines itself hides its re-exports
    of that name; what it defines or names hides what its wildcards bring. A wildcard never brings ``default``.
    Null modules, names and sources make no binding; repeated rows count once."""
    own = write_table(own.select("module", "name").dropna().distinct(), "bind-own")
    named = named.select("module", "name", "source", "source_name").dropna().distinct().join(own, ["module", "name"], "left_anti")
    named = write_table(named, "bind-named")
    wild = write_table(wild.select("module", "source").dropna().where("module != source").distinct(), "bind-wild")
    explicit = write_table(own.union(named.select("module", "name")).distinct(), "bind-explicit")
    delta = write_table(own.select("module", "name", F.col("module").alias("origin"), F.col("name").alias("origin_name"), F.lit(0).alias("hops")), "bind-found")
    found = [delta]
    hops = 0
    while not delta.isEmpty():
        hops += 1
        near = delta.select(F.col("module").alias("source"), F.col("name").alias("source_name"), "origin", "origin_name")
        by_name = near.join(named, ["source", "source_name"]).select(*KEY)
        by_star = near.where("source_name != 'default'").join(wild, "source").select("module", F.col("source_name").alias("name"), "origin", "origin_name")
        by_star = by_star.join(explicit, ["module", "name"], "left_anti")
        fresh = by_name.unionByName(by_star).distinct()
        known = reduce(DataFrame.unionByName, found).select(*KEY)
        delta = write_table(fresh.join(known, KEY, "left_anti").withColumn("hops", F.lit(hops)), "bind-found")
        found.append(delta)
        if hops % 16 == 0:  # one table again, so that the union of a long chain does not grow with it
            merged = write_table(reduce(DataFrame.unionByName, found), "bind-found")
            for part in found:
                if part is not delta:
                    drop_table(part)
            found = [merged]
    return reduce(DataFrame.unionByName, found)


def resolve_exports(own: DataFrame, named: DataFrame, wild: DataFrame) -> DataFrame:
    """(module, name, origin, origin_name, hops, clash): one row for each name of a module. Of several definitions the one of
    fewest hops counts, then the least; ``clash`` tells that there are others."""
    all_ = export_bindings(own, named, wild)
    first = F.min(F.struct("hops", "origin", "origin_name")).alias("b")
    got = all_.groupBy("module", "name").agg(first, (F.count("*") > 1).alias("clash"))
    return got.select("module", "name", F.col("b.origin").alias("origin"), F.col("b.origin_name").alias("origin_name"), F.col("b.hops").alias("hops"), "clash")
