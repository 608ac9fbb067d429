"""Exact links by the Jaccard similarity of shingle sets, which complete those that SimHash signatures find.

Two sets of similarity t or more share k of their first n - ceil(t n) + k shingles in any fixed order (prefix filter).
By the order of the hashes and with k a twentieth of n, a text with fewer than k prefix shingles that stand in another
text's prefix has no partner and leaves at once; so a quarter of the shingles is looked at, and no more is kept of most
texts. Those that stay are ordered
by how many texts hold a shingle, rarest first, and meet on their prefixes under bounds of length, position and parity
(each of 256 bits tells whether an odd number of a set's shingles falls on it, so two sets differ in as many shingles at
least as their bits do); the similarity is verified on whole sets. In large groups a few pivots link most members first; then all pairs of different
components that pass the bounds are compared. Nothing is sampled or capped.

Defined results: texts arrive as shingle sets, so null and empty texts share the set of the empty text and are similar to
each other and to nothing else; repeated rows and texts with equal sets are one set and are linked once, by that set's
representative; shingles of equal rarity are taken in the order of their hashes; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.shingles import hash_set, set_hash, shingle_hashes
from weftgraph.operators.components import connected_components
from weftgraph.storage import drop_table, write_table

#: Rounds in which members of groups are compared with pivots, and pivots a member and round.
PIVOT_ROUNDS, PIVOTS = 2, 4
#: Columns of 64 parity bits each.
PARITY = ["b0", "b1", "b2", "b3"]


#: Share of a set that its prefix is longer than it need be.
MORE = 20


def prefix_length(n: int, similar: tuple[int, int]) -> tuple[int, int]:
    """(length, k): similar sets share k shingles at least of their prefixes of that length, in any fixed order."""
    num, den = similar
    free = n - -(-n * num // den)
    length = min(n, free + max(1, n // MORE))
    return length, length - free


def partners_possible(base: DataFrame) -> DataFrame:
    """Written table of the sid of each set that shares ``least`` of its prefix shingles (keys) or more with other prefixes."""
    keys = base.select("sid", "least", F.explode("keys").alias("key"))
    met = keys.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo != hi").select("key")
    met = write_table(met, "met")
    # copies of a set count its keys once each; all have the same number
    shared = keys.join(met, "key").groupBy("sid", "least").agg(F.count_distinct("key").alias("n"))
    out = write_table(shared.where("n >= least").select("sid"), "partners")
    drop_table(met)
    return out


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Written table (sid, hs, b0 to b3): the sets of the rows (text) given, with their parity bits."""
    kind = T.StructType([T.StructField("sid", T.LongType()), T.StructField("hs", T.ArrayType(T.LongType())), *(T.StructField(b, T.LongType()) for b in PARITY)])
    size = 64 * len(PARITY)

    def parity(hs: np.ndarray) -> np.ndarray:
        return np.packbits(np.bincount(hs & (size - 1), minlength=size) & 1).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                sets = [hash_set(shingle_hashes(t.as_py(), shingle)) for t in whole.column(0).slice(at, 256)]
                sid = pa.array([set_hash(s) for s in sets], pa.int64())
                bits = np.stack([parity(s) for s in sets])
                yield pa.RecordBatch.from_arrays([sid, pa.array(sets, pa.list_(pa.int64())), *(pa.array(bits[:, k].copy()) for k in range(len(PARITY)))], names=kind.names)

    return write_table(texts.select(F.col("text").cast("binary")).mapInArrow(run, kind), "sets")


def _possible(sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Written table of the sets that may have a partner: sid, n, parity bits, common (shingles that other sets
    hold too, rarest first), m (its prefix)."""
    num, den = similar
    each = sets.select("sid", F.size("hs").alias("n"), *PARITY, F.explode("hs").alias("h"))
    shared = write_table(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    held = each.join(shared, "h").groupBy("sid", "n", *PARITY).agg(F.sort_array(F.collect_list(F.struct("df", "h")))["h"].alias("common"))
    # shingles of one text stand first in the order: what is left of the prefix
    least = F.expr(f"(n * {num} + {den - 1}) div {den}").cast("int")
    out = write_table(held.select("sid", "n", *PARITY, "common", (F.size("common") - least + 1).alias("m")).where("m > 0"), "possible")
    drop_table(shared)
    return out


def verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Those of the pairs (src, dst) whose similarity suffices, by whole sets (sid, n, common)."""
    num, den = similar
    a = sets.select(F.col("sid").alias("src"), F.col("n").alias("na"), F.col("common").alias("ca"))
    b = sets.select(F.col("sid").alias("dst"), F.col("n").alias("nb"), F.col("common").alias("cb"))
    both = F.size(F.array_intersect("ca", "cb"))
    return pairs.join(a, "src").join(b, "dst").where(both * (num + den) >= (F.col("na") + F.col("nb")) * num).select("src", "dst")


def _fits(similar: tuple[int, int]) -> Column:
    """Bounds of two index rows, the latter's columns ending in _b: what they can share suffices, what they differ in is not too much, and their components differ.

    With the key at places at and at_b of the common shingles, at most the lesser of the places before it and of those
    behind it can be shared, too."""
    num, den = similar
    most = F.least("at", "at_b") + 1 + F.least(F.col("size") - F.col("at") - 1, F.col("size_b") - F.col("at_b") - 1)
    both = F.col("n") + F.col("n_b")
    differ = reduce(Column.__add__, [F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_b"))) for b in PARITY])
    return (most * (num + den) >= both * num) & (differ * (num + den) <= both * (den - num)) & (F.col("c") != F.col("c_b"))


def similar_links(sets: DataFrame, similar: tuple[int, int], known: DataFrame | None = None) -> DataFrame:
    """Links (src, dst) between distinct sets (sid, hs), all verified; every pair that is similar enough is connected through them.

    known: pairs (src, dst) that are tried first."""
    possible = _possible(sets, similar)
    places = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(k.alias("at"), F.get("common", k).alias("key"), F.get("common", k - 1).alias("prev")))
    index = possible.select("sid", "n", *PARITY, F.size("common").alias("size"), F.explode(places).alias("p")).select("*", "p.*").drop("p")
    met = index.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo != hi").select("key")
    index = write_table(index.join(met, "key", "left_semi").withColumn("c", F.col("sid")), "index")
    links, tests = None, known
    kept = ["key", "sid", "n", *PARITY, "size", "at", "prev"]
    other = [F.col("sid").alias("dst"), *(F.col(x).alias(f"{x}_b") for x in [*kept[2:], "c"])]
    for k in range(PIVOT_ROUNDS + 1):
        if tests is None:
            pivot = index.groupBy("key").agg(F.min_by(F.struct(*other), F.xxhash64("key", "sid", F.lit(k))).alias("p"))
            close = index.join(pivot.select("key", "p.*"), "key").where(_fits(similar)).select(F.col("sid").alias("src"), "dst", F.xxhash64("key", F.lit(k)).alias("o"))
            some = close.groupBy("src").agg(F.slice(F.array_sort(F.collect_set(F.struct("o", "dst"))), 1, PIVOTS)["dst"].alias("ds"))
            tests = some.select("src", F.explode(F.array_distinct("ds")).alias("dst"))
        found = write_table(verified(tests, possible, similar), "links")
        links, tests = found if links is None else links.unionByName(found), None
        labels = connected_components(links)
        near = index.drop("c").join(labels, F.col("sid") == F.col("node"), "left")
        index = write_table(near.select(*kept, F.coalesce("component", "sid").alias("c")), "index")
    # what the pivots left: every pair of different components
    mixed = index.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    rest = write_table(index.join(mixed, "key", "left_semi"), "rest")
    # a pair that meets at the keys before, too, has met there
    new = F.coalesce(F.col("prev") != F.col("prev_b"), F.lit(True))
    pairs = rest.join(rest.select("key", *other), "key").where((F.col("sid") < F.col("dst")) & new & _fits(similar)).select(F.col("sid").alias("src"), "dst")
    pairs = pairs.distinct()
    return links.unionByName(write_table(verified(pairs, possible, similar), "links"))
