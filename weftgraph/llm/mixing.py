"""Mixing sources to target weights by systematic sampling.

Sources get weights in turn and share the size of all documents by weight. A target stops at ``ceiling`` times what its
source has; what is left over is shared again by weight, which is the water level of the sources ordered by cap over
weight and needs one running sum instead of rounds. Within a source every document expects target / size copies. The
expected copies are summed up along the documents, largest first; a random offset of the source is added, and a document
is emitted once for each integer that its share of the sum crosses. With the sizes in order the words taken differ from
the target by less than the source's longest document; no document is taken more than ``ceiling`` times.

Sums are fixed-point integers (2^-31 of a copy), so no total depends on the order of additions and reruns agree.

Defined results: a null text has size 0 and is never counted; null is a source of its own, the last one; a source whose
documents are all empty has target 0; ties in size go by id, then by the text's hash; repeated rows are judged one by
one; other columns are carried in ``row`` untouched, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.prefix import running, same
from weftgraph.storage import bounded_broadcast, write_table

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a copy that sums are counted in.
UNIT = 1 << 31


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """(source, source_size, target, capped) of (source, source_size): no target above ``ceiling`` times the size, all targets together the sum of the sizes."""
    ranked = running(totals, [], [F.col("source").asc_nulls_last()], {"turn": F.lit(1)}, "mix-turns")
    shared = math.lcm(*weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * ceiling)
    # sources in the order in which a rising level reaches their caps
    reached = (wide(F.col("cap")) * (F.lit(shared) / F.col("weight")).cast("decimal(9,0)")).asc()
    filled = running(ranked, [], [reached, F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weighed": F.col("weight")}, "mix-level")
    whole = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    filled = filled.crossJoin(F.broadcast(whole))  # one row
    left, open_ = wide(F.col("all_size") - F.col("caps")), wide(F.col("all_weight") - F.col("weighed"))
    filled = write_table(filled.withColumn("capped", wide(F.col("cap")) * open_ <= wide(F.col("weight")) * left), "mix-sources")
    free = ~F.col("capped")
    level = filled.agg(
        (F.max("all_size") - F.sum(F.when(free, 0).otherwise(F.col("cap")))).alias("left"), F.sum(F.when(free, F.col("weight")).otherwise(0)).alias("open"),
    )
    share = (F.col("weight") * F.col("left")).cast("double") / F.col("open").cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)
    return filled.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"), "capped")  # one row


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in parts of a copy: 28 bits of a digest of the seed and the source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\n"))))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") * 8


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, seed: int = 42,
    text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: row (the carried columns), source, size, source_size, target, copies, taken (copies x size)."""
    sized = write_table(
        docs.select(
            F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"), docs[source_col].cast("string").alias("source"), docs[id_col].alias("id"),
            words(docs[text_col]).alias("size"), F.xxhash64(docs[text_col]).alias("tie"),
        ),
        "mix-sizes",
    )
    totals = write_table(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    per = F.floor(F.col("target") * F.lit(float(UNIT)) / F.col("source_size"))
    per = F.when(F.col("source_size") == 0, F.lit(0)).when(F.col("capped"), F.lit(ceiling * UNIT)).otherwise(per).cast("long")
    targets = source_targets(totals, weights, ceiling).select(F.col("source").alias("of"), "source_size", "target", per.alias("expected"))
    targets = bounded_broadcast(write_table(targets, "mix-targets"))
    aimed = sized.join(targets, same([(F.col("source"), F.col("of"))])).drop("of")
    order = [F.col("size").desc(), F.col("id").asc(), F.col("tie").asc()]
    summed = running(aimed, ["source"], order, {"before": F.col("expected")}, "mix-sums", modulus=UNIT)
    start = F.pmod(F.col("before") + offset(F.col("source"), seed), F.lit(UNIT))
    copies = F.shiftright(start + F.col("expected"), 31)
    return summed.select("row", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def copies_of(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its number (from 0)."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
