"""Ranked search: BM25 over an inverted index, exact vector search in blocks, rank fusion, hybrid ranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index (term, id, tf, len)."""
    t = docs.select(F.col(id_col).alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("ts"))
    exploded = t.select("id", F.size("ts").alias("len"), F.explode("ts").alias("term"))
    return exploded.groupBy("term", "id", "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", limit: int | None = None) -> DataFrame:
    """(id, score) of documents with any query term, best first. One scan: only the query's terms are counted and shuffled."""
    wanted = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    t = docs.select(F.col(id_col).alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("ts"))
    tf = [F.size(F.array_remove(F.col("ts"), w)) for w in wanted]
    counted = t.select("id", F.size("ts").alias("len"), *[(F.size("ts") - n).alias(f"tf{k}") for k, n in enumerate(tf)])
    # a repeated id is one document
    counted = counted.groupBy("id").agg(F.sum("len").alias("len"), *[F.sum(f"tf{k}").alias(f"tf{k}") for k in range(len(wanted))])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum(F.when(F.col(f"tf{k}") > 0, 1).otherwise(0)).alias(f"df{k}") for k in range(len(wanted))])
    joined = counted.where(reduce(Column.__or__, [F.col(f"tf{k}") > 0 for k in range(len(wanted))], F.lit(False))).join(F.broadcast(stats))  # one row

    def part(k: int) -> Column:
        tf_, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return idf * tf_ * (K1 + 1) / (tf_ + K1 * (1 - B + B * F.col("len") / F.col("avg")))

    score = reduce(Column.__add__, [part(k) for k in range(len(wanted))], F.lit(0.0))
    ranked = joined.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id")
    return ranked if limit is None else ranked.limit(limit)


def ranked(df: DataFrame, order: list[Column], start: int = 1) -> DataFrame:
    """``rank`` by position, for result lists that a limit has bounded."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1 + start)


def rrf(lists: dict[str, DataFrame], key: str = "id", start: int = 1, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank): the sum of 1 / (k + rank), and the sources. ``start`` is 0 for the
    tool's ranks and 1 for the library's; the ranks must count from it."""
    every = reduce(DataFrame.unionByName, [d.select(key, F.col("rank"), F.lit(n).alias("source")) for n, d in lists.items()])
    out = every.where(F.col("rank") >= start).groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.sort_array(F.collect_set("source")).alias("sources"))
    return out.withColumn("score", F.round("score", 9))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, max_distance: float | None = None, block: int = 512) -> DataFrame:
    """(query_id, id, distance): the k nearest vectors by cosine distance, exactly; ties by id.

    Queries (query_id, vector) go in blocks of ``block`` rows to every partition of ``vectors`` (id, vector); each partition
    keeps its k best for a query, so k rows a query and partition are shuffled. Null and zero vectors are left out."""
    spark = vectors.sparkSession
    q = queries.where("query_id is not null and vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())])
    v = vectors.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    parts: list[DataFrame] = []
    pending: list = []

    def search(rows: list) -> DataFrame:
        ids = np.array([r.query_id for r in rows], np.int64)
        unit = np.array([r.vector for r in rows])
        size = np.linalg.norm(unit, axis=1)
        ids, unit = ids[size > 0], unit[size > 0] / size[size > 0, None]
        shared = spark.sparkContext.broadcast((ids, unit))  # at most ``block`` vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            best = {i: [] for i in q_ids.tolist()}
            for b in batches:
                if not len(b):
                    continue
                x = np.stack([np.asarray(r.as_py()) for r in b.column(1)])
                n = np.linalg.norm(x, axis=1)
                own, x = b.column(0).to_numpy()[n > 0], x[n > 0] / n[n > 0, None]
                d = np.round(1.0 - q @ x.T, 9)
                for row, i in enumerate(q_ids.tolist()):
                    order = np.lexsort((own, d[row]))[:k]
                    best[i] = sorted(best[i] + list(zip(d[row][order].tolist(), own[order].tolist())))[:k]
            flat = [(i, o, dist) for i, found in best.items() for dist, o in found if max_distance is None or dist < max_distance]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat)], names=["query_id", "id", "distance"])

        return v.mapInArrow(run, schema)

    for row in q.toLocalIterator():
        pending.append(row)
        if len(pending) == block:
            parts.append(search(pending))
            pending = []
    if pending:
        parts.append(search(pending))
    if not parts:
        return spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within(vectors: DataFrame, queries: DataFrame, max_distance: float, block: int = 512) -> DataFrame:
    """(query_id, n): how many vectors lie nearer than ``max_distance`` by cosine distance (rounded to 9 digits); queries with none make no row.

    Queries go in blocks as in ``nearest``; each partition counts for itself, so one row a query and partition is shuffled.
    Null and zero vectors are left out."""
    spark = vectors.sparkSession
    q = queries.where("query_id is not null and vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    v = vectors.where("vector is not null").select(F.col("vector").cast("array<double>").alias("vector"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("n", T.LongType())])

    def count(rows: list) -> DataFrame:
        ids = np.array([r.query_id for r in rows], np.int64)
        unit = np.array([r.vector for r in rows])
        size = np.linalg.norm(unit, axis=1)
        ids, unit = ids[size > 0], unit[size > 0] / size[size > 0, None]
        shared = spark.sparkContext.broadcast((ids, unit))  # at most ``block`` vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            total = np.zeros(len(q_ids), np.int64)
            for b in batches:
                if not len(b):
                    continue
                x = np.stack([np.asarray(r.as_py()) for r in b.column(0)])
                n = np.linalg.norm(x, axis=1)
                x = x[n > 0] / n[n > 0, None]
                total += (np.round(1.0 - q @ x.T, 9) < max_distance).sum(1)
            some = total > 0
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[some]), pa.array(total[some])], names=["query_id", "n"])

        return v.mapInArrow(run, schema)

    parts: list[DataFrame] = []
    pending: list = []
    for row in q.toLocalIterator():
        pending.append(row)
        if len(pending) == block:
            parts.append(count(pending))
            pending = []
    if pending:
        parts.append(count(pending))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts).groupBy("query_id").agg(F.sum("n").alias("n"))


#: Least score of a sure pick, and how much more it must have than the next (fixed values).
SURE, GAP = 0.95, 0.09


def confident(candidates: DataFrame, key: str, sure: float = SURE, gap: float = GAP) -> DataFrame:
    """(key, id, score, sure): the best candidate (key, id, score) of each key, ties by id, and whether it stands out.

    Two maxima over structs, so that candidates combine before the shuffle and no key is sorted in one task."""
    rank = F.struct(F.col("score").alias("s"), (-F.col("id")).alias("i"))
    best = candidates.groupBy(key).agg(F.max(rank).alias("b")).select(key, F.col("b.s").alias("score"), (-F.col("b.i")).alias("id"))
    rest = candidates.join(best.select(F.col(key).alias("k"), F.col("id").alias("first")), F.col(key) == F.col("k")).where("id != first")
    second = rest.groupBy(key).agg(F.max("score").alias("next"))
    ahead = F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 6)
    return best.join(second, key, "left").select(key, "id", "score", ((F.col("score") >= sure) & (ahead > gap)).alias("sure"))


def bm25_fields(docs: DataFrame, query: str, fields: list[str], id_col: str = "id", stemmed: bool = True, limit: int | None = None) -> DataFrame:
    """(id, score): BM25 of each text field, summed; with ``stemmed`` words and query meet on their Porter stems."""
    from weftgraph.functions.stems import porter, stems

    words = "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()
    asked = " ".join(porter(w) for w in words) if stemmed else " ".join(words)
    scored = []
    for f in fields:
        own = terms(F.coalesce(F.col(f), F.lit("")))
        texts = docs.select(F.col(id_col).alias("id"), F.array_join(stems(own) if stemmed else own, " ").alias("text"))
        scored.append(bm25(texts, asked, "id"))
    total = reduce(DataFrame.unionByName, scored).groupBy("id").agg(F.round(F.sum("score"), 6).alias("score")).orderBy(F.desc("score"), "id")
    return total if limit is None else total.limit(limit)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def process_ranking(symbols: DataFrame) -> DataFrame:
    """Processes by the sum of their symbols' scores plus a tenth of the largest cohesion: (process, total, cohesion, priority)."""
    g = symbols.groupBy("process").agg(F.sum("score").alias("total"), F.max("cohesion").alias("cohesion"))
    return g.withColumn("priority", F.round(F.col("total") + 0.1 * F.col("cohesion"), 6))
