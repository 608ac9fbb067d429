"""Source divergence audit: a K-squared tree over the matrix of (source, term) counts of each language.

A language's matrix has a row for each source and a column for each kept term, the widespread terms first. Cells that
are not zero are gathered in leaves of SIDE x SIDE; above them each level joins K x K quadrants into one. Two row blocks
walk the tree together from the root: a quadrant that is empty for both is uniform (every row has its one smoothed
probability for an absent term there), so its price is its number of columns times the difference of the two, found
without a look at its cells; any other quadrant is opened, and at the leaves the differences of 16 x 16 pairs of groups
are summed at once.

Probabilities are integers, p = 1 + floor(SCALE * (count + ADD) / (N + ADD * V)), and all sums are exact.

Defined results: null text, language and source count as empty strings; a group without terms takes part with counts of
0; a language without kept terms has pair values of 0 and no term rows; equal values go by item in UTF-8 order;
repeated documents count each time; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.prefix import running
from weftgraph.storage import bounded_broadcast, write_table

SCALE, ADD = 1_000_000_000, 5
#: Quadrants by side of an inner node, and rows and columns of a leaf.
K, SIDE = 16, 16
#: Distinct (group, term) entries that a counting task holds before it hands them on.
HELD = 400_000
#: Row-block pairs whose sums a leaf task holds before it hands them on.
HELD_PAIRS = 4_000
#: Leaves that are compared at once.
CHUNK = 128

#: Bytes of a term stay, A-Z lower-cased; all other bytes become spaces.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _flush(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), c in counts.items():
        d = docs[lang, source]
        terms = list(c)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)),
                pa.concat_arrays([pa.array(terms, pa.binary()), pa.nulls(1, pa.binary())]).cast(pa.string()),
                pa.array([*c.values(), 0], pa.int64()), pa.array([*(d[t] for t in terms), 0], pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            words = text.translate(TERM_BYTES).split()
            if (group := (lang, source)) not in counts:
                counts[group], docs[group] = Counter(), Counter()
            counts[group].update(words)
            docs[group].update(set(words))
        if sum(map(len, counts.values())) > HELD:
            yield from _flush(counts, docs)
            counts, docs = {}, {}
    yield from _flush(counts, docs)


def group_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Written table (lang, source, term, n occurrences, docs that have it); a null term stands for the group itself."""
    read = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return write_table(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "div-terms")


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """p of a count in a group of ``total`` occurrences over ``terms`` kept terms, exactly."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + ADD).cast("decimal(19,0)")
    return F.call_function("div", scaled, (total + ADD * terms).cast("decimal(20,0)")) + 1


class Matrix:
    """The written tables of an audit.

    ``groups``: lang, source, g (row number in the language), n (sum of counts), terms (V), absent (p of count 0).
    ``cells``: lang, source, term, g, t (column number), p, q (the term's p in the language).
    ``terms``: lang, v (kept terms)."""

    def __init__(self, docs: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int) -> None:
        every = group_terms(docs, lang_col, source_col, text_col)
        kept = every.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("in_lang")).where(F.col("in_docs") >= min_docs)
        columns = running(kept, ["lang"], [F.col("in_docs").desc(), F.col("term").asc()], {"t": F.lit(1)}, "div-columns")
        columns = bounded_broadcast(write_table(columns.select(F.col("lang").alias("l"), F.col("term").alias("w"), "in_lang", "t"), "div-kept"))
        present = write_table(every.where("term is not null").join(columns, (F.col("lang") == F.col("l")) & (F.col("term") == F.col("w"))).select("lang", "source", "term", "n", "in_lang", "t"), "div-cells")
        v = columns.groupBy("l").agg(F.count("*").alias("v"), F.sum("in_lang").alias("all_n"))
        langs = every.select("lang").distinct().join(v, F.col("lang") == F.col("l"), "left")
        self.terms = write_table(langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all_n", F.lit(0)).alias("all_n")), "div-langs")
        n = present.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        named = every.where("term is null").select("lang", "source").join(n, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
        rows = running(named, ["lang"], [F.col("source").asc()], {"g": F.lit(1)}, "div-rows").join(bounded_broadcast(self.terms), "lang")
        absent = F.when(F.col("v") > 0, smoothed(F.lit(0), F.col("n"), F.col("v")))
        self.groups = write_table(rows.select("lang", "source", "g", "n", "v", "all_n", absent.alias("absent")), "div-groups")
        of = bounded_broadcast(self.groups.select("lang", "source", "g", F.col("n").alias("total"), "v", "all_n"))
        self.cells = write_table(
            present.join(of, ["lang", "source"]).select(
                "lang", "source", "term", "g", "t", smoothed(F.col("n"), F.col("total"), F.col("v")).alias("p"), smoothed(F.col("in_lang"), F.col("all_n"), F.col("v")).alias("q"),
            ),
            "div-matrix",
        )


LEAF_SUMS = "lang string, r1 long, r2 long, sums array<long>"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |p - p'| over the columns of a leaf, for each pair of its rows: added up by pair of row blocks."""
    held: dict[tuple, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        lang, r1, r2 = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(r1, pa.int64()), pa.array(r2, pa.int64()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))], names=["lang", "r1", "r2", "sums"])

    def dense(absent: pa.Array, cells: pa.Array, ps: pa.Array, n: int) -> np.ndarray:
        block = np.zeros((n, SIDE, SIDE), np.int64)
        for i, rows in enumerate(absent.to_pylist()):
            block[i, : len(rows)] = np.array(rows)[:, None]
        sizes = np.nan_to_num(pa.compute.list_value_length(cells).to_numpy(zero_copy_only=False)).astype(int)
        block.reshape(n, -1)[np.repeat(np.arange(n), sizes), cells.flatten().to_numpy(zero_copy_only=False)] = ps.flatten().to_numpy(zero_copy_only=False)
        return block

    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            b = whole.slice(at, CHUNK)
            lang, r1, r2 = (b.column(i).to_pylist() for i in range(3))
            wide = (np.arange(SIDE) < b.column(3).to_numpy()[:, None]).astype(np.int64)
            x, y = (dense(b.column(i), b.column(i + 1), b.column(i + 2), len(lang)) for i in (4, 7))
            sums = (np.abs(x[:, :, None, :] - y[:, None, :, :]) * wide[:, None, None, :]).sum(3).reshape(len(lang), -1)
            for i, key in enumerate(zip(lang, r1, r2)):
                held[key] = held[key] + sums[i] if key in held else sums[i]
        if len(held) > HELD_PAIRS:
            yield out()
            held = {}
    if held:
        yield out()


def _children(node: str, below: int, bound: str, last: str | None = None) -> Column:
    """Numbers of the blocks of side ``below`` in block ``node`` of side ``below`` * K: those that begin before ``bound``."""
    first = F.col(node) * K if last is None else F.greatest(F.col(node) * K, F.col(last))
    return F.sequence(first, F.least(F.col(node) * K + K - 1, F.floor((F.col(bound) - 1) / below)))


def pair_values(m: Matrix) -> DataFrame:
    """(lang, g1, g2, value) for g1 < g2: the sum of |p - p'| over all kept terms, by one joint walk of the tree."""
    block = F.struct((F.col("g") % SIDE * SIDE + F.col("t") % SIDE).cast("short").alias("cell"), F.col("p").cast("int").alias("p"))
    leaves = m.cells.groupBy("lang", F.floor(F.col("g") / SIDE).alias("r"), F.floor(F.col("t") / SIDE).alias("c")).agg(F.collect_list(block).alias("x"))
    leaves = write_table(leaves.select("lang", "r", "c", F.col("x.cell").alias("cells"), F.col("x.p").alias("ps")), "div-leaves")
    blocks = m.groups.groupBy("lang", F.floor(F.col("g") / SIDE).alias("r")).agg(F.array_sort(F.collect_list(F.struct("g", "absent"))).alias("x"))
    blocks = write_table(blocks.select("lang", "r", F.col("x.absent").alias("absent")), "div-blocks")
    sizes = m.groups.where("v > 0").groupBy("lang").agg(F.count("*").alias("rows"), F.first("v").alias("v"))
    most = sizes.agg(F.max(F.greatest("rows", "v"))).first()[0] or 0
    depth = 0
    while SIDE * K**depth < most:
        depth += 1
    walk = sizes.select("lang", "rows", "v", *[F.lit(0).cast("long").alias(c) for c in ("r1", "r2", "c")])
    empty = None
    for level in range(depth - 1, -1, -1):
        side = SIDE * K**level
        nodes = leaves.select("lang", F.floor(F.col("r") / K**level).alias("r"), F.floor(F.col("c") / K**level).alias("c")).distinct() if level else leaves.select("lang", "r", "c")
        nodes = bounded_broadcast(write_table(nodes, f"div-level{level}"))
        step = walk.withColumn("c", F.explode(_children("c", side, "v"))).withColumn("a", F.explode(_children("r1", side, "rows"))).withColumn("b", F.explode(_children("r2", side, "rows", "a")))
        step = step.select("lang", "rows", "v", F.col("a").alias("r1"), F.col("b").alias("r2"), "c")
        for mine in ("r1", "r2"):
            there = nodes.select(F.col("lang").alias("l"), F.col("r").alias("nr"), F.col("c").alias("nc"), F.lit(True).alias(f"has_{mine}"))
            step = step.join(there, (F.col("lang") == F.col("l")) & (F.col(mine) == F.col("nr")) & (F.col("c") == F.col("nc")), "left").drop("l", "nr", "nc")
        step = write_table(step.withColumn("open", F.coalesce("has_r1", "has_r2", F.lit(False))).drop("has_r1", "has_r2"), f"div-walk{level}")
        walk = step.where("open").drop("open")
        columns = F.least(F.col("v"), (F.col("c") + 1) * side) - F.col("c") * side
        uniform = step.where("not open").groupBy("lang", F.lit(side).cast("long").alias("side"), "r1", "r2").agg(F.sum(columns).alias("columns"))
        empty = uniform if empty is None else empty.unionByName(uniform)
    pairs = walk.withColumn("columns", (F.least(F.col("v"), (F.col("c") + 1) * SIDE) - F.col("c") * SIDE).cast("long"))
    for k, mine in ((1, "r1"), (2, "r2")):
        info = bounded_broadcast(blocks.select(F.col("lang").alias("l"), F.col("r").alias("br"), F.col("absent").alias(f"absent{k}")))
        cells = leaves.select(F.col("lang").alias("l"), F.col("r").alias("br"), F.col("c").alias("bc"), F.col("cells").alias(f"cells{k}"), F.col("ps").alias(f"ps{k}"))
        pairs = pairs.join(info, (F.col("lang") == F.col("l")) & (F.col(mine) == F.col("br"))).drop("l", "br")
        pairs = pairs.join(cells, (F.col("lang") == F.col("l")) & (F.col(mine) == F.col("br")) & (F.col("c") == F.col("bc")), "left").drop("l", "br", "bc")
    leaf_sums = pairs.select("lang", "r1", "r2", "columns", *[f"{c}{k}" for k in (1, 2) for c in ("absent", "cells", "ps")]).mapInArrow(_compare, LEAF_SUMS)
    flat = leaf_sums.select("lang", "r1", "r2", F.posexplode("sums").alias("at", "value"))
    g1, g2 = F.col("r1") * SIDE + F.floor(F.col("at") / SIDE), F.col("r2") * SIDE + F.col("at") % SIDE
    opened = flat.select("lang", g1.alias("g1"), g2.alias("g2"), "value").where("g1 < g2")
    absent = m.groups.select("lang", F.col("g").alias("g1"), F.col("absent").alias("p1"))
    # the contract asks for every pair of groups of a language, so the pairs themselves are the result's size
    every = absent.join(m.groups.select("lang", F.col("g").alias("g2"), F.col("absent").alias("p2")), "lang").where("g1 < g2")
    value = every.select("lang", "g1", "g2", F.lit(0).cast("long").alias("value"))
    if empty is not None:
        sides = F.explode(F.array(*[F.lit(SIDE * K**level).cast("long") for level in range(depth)]))
        placed = every.withColumn("side", sides).withColumns({"r1": F.floor(F.col("g1") / F.col("side")), "r2": F.floor(F.col("g2") / F.col("side"))})
        priced = placed.join(bounded_broadcast(write_table(empty, "div-uniform")), ["lang", "side", "r1", "r2"])
        value = value.unionByName(priced.select("lang", "g1", "g2", (F.col("columns") * F.abs(F.col("p1") - F.col("p2"))).alias("value")))
    return value.unionByName(opened.join(bounded_broadcast(sizes.select("lang", "rows")), "lang").where("g2 < rows").select("lang", "g1", "g2", "value")).groupBy("lang", "g1", "g2").agg(F.sum("value").alias("value"))


def audit_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to every other source of the language, and the terms that a source has too often."""
    m = Matrix(docs, lang_col, source_col, text_col, min_docs)
    halves = write_table(pair_values(m), "div-pairs")
    both = halves.unionByName(halves.select("lang", F.col("g2").alias("g1"), F.col("g1").alias("g2"), "value"))
    names = bounded_broadcast(m.groups.select("lang", "source", "g"))
    named = both.join(names.withColumnRenamed("g", "g1"), ["lang", "g1"]).join(names.select("lang", F.col("source").alias("item"), F.col("g").alias("g2")), ["lang", "g2"])
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    over = m.cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
