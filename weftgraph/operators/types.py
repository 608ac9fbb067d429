"""Types across files: what an annotation or return type in one module says about names in the modules that import it.

Modules are worked through in finalisation order, so a level joins only its own imports to types that are final; modules
of one import cycle share a level and are repeated until nothing changes. Each level is a written table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import finalisation_order
from weftgraph.storage import dealt, drop_table, write_table

#: The share of imported names without a type below which nothing is propagated (a fixed value).
LEAST_GAP = 0.03
KEY = ["module", "name"]


def import_gap(own: DataFrame, imports: DataFrame) -> float:
    """The share of imported names (module, name) that have no type of their own."""
    named = imports.select(*KEY).distinct().join(dealt(own.select(*KEY).distinct().withColumn("typed", F.lit(1))), KEY, "left")
    row = named.agg(F.count("*").alias("n"), F.count("typed").alias("typed")).first()
    return 1 - row["typed"] / row["n"] if row["n"] else 0.0


def propagate_types(own: DataFrame, imports: DataFrame, assigns: DataFrame | None = None, least_gap: float = LEAST_GAP) -> DataFrame:
    """(module, name, type, level) of all names that have a type or get one; a name's own types come with level null.

    ``own`` is (module, name, type), ``imports`` (module, name, source, source_name), ``assigns`` (module, name, source_name)
    for a name that takes the type of another of its module, such as a variable that is set to a call. A name with a type of
    its own keeps it; of several types that reach a name the least counts. Nulls make no type; with a gap below
    ``least_gap`` only own types are returned."""
    own = write_table(own.select(*KEY, "type").dropna().groupBy(*KEY).agg(F.min("type").alias("type")).withColumn("level", F.lit(None).cast("int")), "types-own")
    imports = write_table(imports.select(*KEY, "source", "source_name").dropna().distinct(), "types-imports")
    if import_gap(own, imports) < least_gap:
        return own
    inside = imports.select(*KEY, F.col("module").alias("source"), "source_name").limit(0) if assigns is None else assigns.select(*KEY, F.col("module").alias("source"), "source_name").dropna().distinct()
    order = finalisation_order(imports.select(F.col("module").alias("src"), F.col("source").alias("dst"))).select(F.col("node").alias("module"), "level")
    steps = imports.unionByName(inside).join(dealt(own.select(*KEY)), KEY, "left_anti").join(dealt(order), "module", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    steps = write_table(steps, "types-steps")
    last = steps.agg(F.max("level")).first()[0]
    final = [own]
    for level in range((last if last is not None else -1) + 1):
        mine = steps.where(F.col("level") == level)
        below = write_table(mine.join(dealt(_named(reduce(DataFrame.unionByName, final))), ["source", "source_name"]).groupBy(*KEY).agg(F.min("type").alias("type")), "types-level")
        now = below
        while True:  # one round more than the longest way inside the level's modules
            sent = mine.join(dealt(_named(now)), ["source", "source_name"]).groupBy(*KEY).agg(F.min("type").alias("sent"))
            both = now.join(dealt(sent), KEY, "full").select(*KEY, F.least("type", "sent").alias("new"), "type")
            nxt = write_table(both, "types-level")
            changed = nxt.where("type is null or new < type").limit(1).count()
            drop_table(now)
            now = nxt.select(*KEY, F.col("new").alias("type"))
            now._weft_path = nxt._weft_path
            if not changed:
                break
        final.append(now.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, final)


def _named(types: DataFrame) -> DataFrame:
    return types.select(F.col("module").alias("source"), F.col("name").alias("source_name"), "type")
