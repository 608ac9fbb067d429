"""A stored vector index: inverted lists with product-quantised residuals, for cosine distance.

Layout below one folder: ``model`` (centroids of the lists and of the residuals' parts), ``rows`` (partitioned by list:
id, code, how far the vector lies from its list's centroid and from what its code stands for, and the vector itself).
The model is fitted on a bounded sample; every row is assigned. A search reads the lists that its queries probe (the
scan is pruned by partition, and the column of vectors is read for the candidates only), compares codes by tables of
partial distances, and ranks the best candidates again by exact distance.

Recall is a matter of ``probes`` and ``rerank``. ``search(..., complete=True)`` proves its answer instead: the first answer
bounds the distance of the k-th neighbour, lists and rows that the triangle inequality puts beyond that bound are left
out, and all others are compared exactly.

Null ids, null vectors and zero vectors are left out; repeated ids are rows of their own; ties go by id.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.storage import bounded_broadcast, delete_path, write_table

#: Most lists of an index; rows and bytes of the sample that the model is fitted on; rounds of each fit.
MOST_LISTS, SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS = 4096, 65_536, 64 << 20, 12
#: Codewords of a part, and most parts of a vector.
WORDS, MOST_PARTS = 256, 16
#: Rows of a list and queries that one task compares at a time.
LIST_ROWS, QUERY_ROWS = 1 << 16, 256
#: What rounding may add to a stored distance.
SLACK = 1e-4
#: The share of true neighbours whose lists a search looks at, and the rows of the sample that this is measured with.
PROBED, TRIED = 0.97, 256


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest centre and the squared distance to it."""
    found, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    norms = (centres**2).sum(1)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = norms - 2 * part @ centres.T
        own = d.argmin(1)
        found[at : at + 4096] = own
        dist[at : at + 4096] = d[np.arange(len(part)), own] + (part**2).sum(1)
    return found, np.maximum(dist, 0)


def _fit(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of at most ``k`` clusters; an empty cluster takes the row that lies farthest from its centre."""
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own, dist = _nearest(x, centres)
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
        if (empty := np.flatnonzero(sizes == 0)).size:
            centres[empty] = x[np.argsort(-dist)[: len(empty)]]
    return centres


def _probes(x: np.ndarray, centres: np.ndarray) -> int:
    """How many lists hold PROBED of the ten nearest of the first rows of ``x`` among its rows: the lists that a search looks at.

    In the whole table neighbours are nearer than in the sample, so they lie in no more lists."""
    own, _ = _nearest(x, centres)
    q = x[:TRIED]
    near = np.argsort(-(q @ x.T), axis=1)[:, :10]
    order = np.argsort((centres**2).sum(1) - 2 * q @ centres.T, axis=1)
    place = np.argsort(order, axis=1)
    places = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(places[min(len(places) - 1, int(PROBED * len(places)))]) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as unit vectors."""
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that have an id and a vector that is not zero."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return v.where("id is not null and vector is not null and exists(vector, x -> x <> 0)")


class _Model:
    """Centroids of the lists, and codewords of each part of a residual."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]) -> None:
        self.centres, self.books, self.step = centres, books, centres.shape[1] // len(books)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code, distance from the list's centroid, and from what list and code stand for."""
        own, far = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes, lost = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for p, book in enumerate(self.books):
            codes[:, p], d = _nearest(rest[:, p * self.step : (p + 1) * self.step], book)
            lost += d
        return own, codes, np.sqrt(far), np.sqrt(lost)

    def compare(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries (rows) to what the codes of list ``at`` stand for."""
        rest, total = q - self.centres[at], np.zeros((len(q), len(codes)))
        for p, book in enumerate(self.books):
            part = rest[:, p * self.step : (p + 1) * self.step]
            total += ((part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T)[:, codes[:, p]]
        return np.sqrt(np.maximum(total, 0))


ROW = "list int, id long, code binary, far float, lost float, vector array<float>"


class VectorIndex:
    """An index stored below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        """Open what ``create`` has written."""
        self.spark, self.path = spark, path.rstrip("/")
        kept = spark.read.parquet(f"{self.path}/model").orderBy("part", "word").toArrow()  # at most MOST_LISTS + MOST_PARTS x WORDS rows
        parts, values = np.array(kept["part"]), kept["value"].to_pylist()
        group = lambda p: np.array([v for v, own in zip(values, parts) if own == p])
        self._load(_Model(group(-1), [group(p) for p in range(parts.max() + 1)]))
        self.probes = int(group(-2)[0, 0])

    def _load(self, model: _Model) -> None:
        self.model = self.spark.sparkContext.broadcast(model)

    @classmethod
    def create(cls, vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "vector", lists: int | None = None, parts: int | None = None, seed: int = 7) -> VectorIndex:
        """Fit on a sample of at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes (those whose ids hash least) and store every row.

        ``lists`` is the root of the number of rows unless given, ``parts`` the largest divisor of the dimension up to MOST_PARTS."""
        spark, usable = vectors.sparkSession, _usable(vectors, id_col, vector_col)
        about = usable.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("most"), F.min(F.size("vector")).alias("least")).first()
        if not about["n"]:
            raise ValueError("no vectors to index")
        if about["most"] != about["least"]:
            raise ValueError(f"vectors of {about['least']} to {about['most']} dimensions")
        dims, lists = about["most"], min(MOST_LISTS, lists or math.isqrt(about["n"]) + 1)
        parts = parts or max(p for p in range(1, MOST_PARTS + 1) if dims % p == 0)
        rows = max(lists, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
        sample = usable.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows).select("vector").toArrow()
        x, rng = _matrix(sample["vector"].combine_chunks()), np.random.default_rng(seed)
        centres = _fit(x, lists, rng)
        rest = x - centres[_nearest(x, centres)[0]]
        books = [_fit(p, WORDS, rng) for p in np.split(rest, parts, axis=1)]
        words = [(p, w, v.tolist()) for p, book in enumerate([centres, *books], -1) for w, v in enumerate(book)]
        words.append((-2, 0, [float(_probes(x, centres))]))
        spark.createDataFrame(words, "part int, word int, value array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/model")
        index = cls(spark, path)
        index.add(vectors, id_col, vector_col)
        return index

    def add(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "vector") -> None:
        """Store more rows under the fitted model. Rows are dealt by (list, hash of the id), so a large list makes many files."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(1))
                own, codes, far, lost = model.value.encode(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far, pa.float32()), pa.array(lost, pa.float32()), b.column(1).cast(pa.list_(pa.float32()))],
                    names=["list", "id", "code", "far", "lost", "vector"],
                )

        coded = _usable(vectors, id_col, vector_col).mapInArrow(run, ROW)
        coded.repartitionByRange("list", F.xxhash64("id")).write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW).parquet(f"{self.path}/rows")

    def drop(self) -> None:
        """Delete the index."""
        delete_path(self.spark, self.path)

    def sizes(self) -> DataFrame:
        """(list, n, far): rows of each list and its radius."""
        return self.rows().groupBy("list").agg(F.count("*").alias("n"), F.max("far").cast("double").alias("far"))

    def _pairs(self, queries: DataFrame, probes: int | None, radius: dict[int, float] | None = None) -> DataFrame:
        """(query_id, vector, bound, list): the ``probes`` nearest lists of each query, or all that may hold a row within its bound."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = model.value.centres
            reach = None if radius is None else np.array([radius.get(i, -1.0) for i in range(len(centres))])
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(1))
                d = np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T, 0)
                if reach is None:
                    own = np.argpartition(d, min(probes, len(centres)) - 1, axis=1)[:, :probes]
                    rows, lists = np.repeat(np.arange(len(x)), own.shape[1]), own.ravel()
                else:
                    rows, lists = np.nonzero((np.sqrt(d) - reach <= b.column(2).to_numpy()[:, None] + SLACK) & (reach >= 0))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in range(3)] + [pa.array(lists, pa.int32())], names=["query_id", "vector", "bound", "list"])

        return queries.mapInArrow(run, "query_id long, vector array<double>, bound double, list int")

    def _candidates(self, pairs: DataFrame, sizes: DataFrame, keep: int, proven: bool = False) -> DataFrame:
        """(query_id, list, id, near): of each list the ``keep`` rows whose codes lie nearest.

        If ``proven``, ``near`` is the exact cosine distance: rows whose codes put them beyond the query's bound are left
        out unseen, and of the others the ``keep`` nearest within the bound are given. Lists go in pieces of about
        LIST_ROWS rows and queries in blocks of about QUERY_ROWS, so no task holds a whole large list."""
        model, asked = self.model, pairs.groupBy("list").agg(F.count("*").alias("asked"))
        share = sizes.join(asked, "list").select("list", F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("pieces"), F.ceil(F.col("asked") / QUERY_ROWS).cast("int").alias("blocks"))
        share = write_table(share, "index-share")
        lists = [r["list"] for r in share.select("list").collect()]  # at most MOST_LISTS numbers
        share = F.broadcast(share)  # a row for each list
        piece, block = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        read = ["id", "code", "lost", "vector"] if proven else ["id", "code"]
        stored = self.rows().where(F.col("list").isin(lists)).select("list", *read).join(share, "list").withColumn("piece", piece).withColumn("block", every("blocks"))
        wanted = pairs.join(share, "list").withColumn("block", block).withColumn("piece", every("pieces"))
        keys = ["list", "piece", "block"]

        def run(key: tuple, q: pa.Table, rows: pa.Table) -> pa.Table:
            shape = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("id", pa.int64()), ("near", pa.float64())])
            if not q.num_rows or not rows.num_rows:
                return shape.empty_table()
            at, asked = int(key[0].as_py()), _matrix(q["vector"].combine_chunks())
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            near, ids, bound = model.value.compare(asked, at, codes), rows["id"].to_numpy(), q["bound"].to_numpy()[:, None]
            if proven:
                seen = np.flatnonzero((near - rows["lost"].to_numpy() <= bound + SLACK).any(axis=0))
                if not len(seen):
                    return shape.empty_table()
                near, ids = np.round(1.0 - asked @ _matrix(rows["vector"].combine_chunks().take(pa.array(seen))).T, 9), ids[seen]
            if keep < len(ids):
                b = np.lexsort((np.broadcast_to(ids, near.shape), near), axis=1)[:, :keep]
                a, b = np.repeat(np.arange(len(b)), b.shape[1]), b.ravel()
            else:
                a, b = (x.ravel() for x in np.indices(near.shape))
            if proven:  # a cosine distance is half a squared distance of unit vectors
                inside = 2 * near[a, b] <= (bound[a, 0] + SLACK) ** 2
                a, b = a[inside], b[inside]
            return pa.table([q["query_id"].take(pa.array(a)), pa.array(np.full(len(a), at, np.int32)), pa.array(ids[b]), pa.array(near[a, b])], schema=shape)

        left = wanted.select(*keys, "query_id", "vector", "bound").groupBy(*keys)
        return left.cogroup(stored.select(*keys, *read).groupBy(*keys)).applyInArrow(run, "query_id long, list int, id long, near double")

    def _exact(self, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest of (query_id, list, id) by exact distance."""
        found = write_table(found, "index-found")
        lists = [r["list"] for r in found.select("list").distinct().collect()]  # at most MOST_LISTS numbers
        vectors = self.rows().where(F.col("list").isin(lists)).select("list", "id", "vector")
        met = vectors.join(bounded_broadcast(found), ["list", "id"]).join(bounded_broadcast(queries.select("query_id", F.col("vector").alias("q"))), "query_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = np.round(1.0 - (_matrix(b.column(2)) * _matrix(b.column(3))).sum(1), 9)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], names=["query_id", "id", "distance"])

        distances = met.select("query_id", "id", "vector", "q").mapInArrow(run, "query_id long, id long, distance double")
        best = Window.partitionBy("query_id").orderBy("distance", "id")
        return distances.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int = 40, complete: bool = False) -> DataFrame:
        """(query_id, id, distance, rank): about the k nearest rows of each query (query_id, vector), or exactly these if ``complete``.

        ``probes`` lists are looked at (by default as many as hold PROBED of the sample's neighbours), and ``rerank`` x k
        candidates of a query, by their codes, are compared exactly."""
        q = _usable(queries, "query_id", "vector").select(F.col("id").alias("query_id"), "vector", F.lit(0.0).alias("bound"))
        q = write_table(q, "index-queries")
        sizes = write_table(self.sizes(), "index-sizes")
        coarse = self._candidates(write_table(self._pairs(q, probes or self.probes), "index-pairs"), sizes, keep=rerank * k)
        nearest = Window.partitionBy("query_id").orderBy("near", "id")
        found = coarse.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= rerank * k).select("query_id", "list", "id")
        ranked = self._exact(found, q, k)
        if not complete:
            return ranked
        # unit vectors: the squared distance is twice the cosine distance
        worst = write_table(ranked.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.sqrt(2 * F.greatest("distance", F.lit(0.0))).alias("worst")), "index-worst")
        bound = F.coalesce("worst", F.lit(2.0)) + SLACK
        bounded = write_table(q.join(worst, F.col("query_id") == F.col("of"), "left").select("query_id", "vector", bound.alias("bound")), "index-bounds")
        radius = {r["list"]: r["far"] for r in sizes.collect()}  # at most MOST_LISTS rows
        pairs = write_table(self._pairs(bounded, None, radius), "index-pairs")
        within = self._candidates(pairs, sizes, keep=k, proven=True)
        return within.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "id", F.col("near").alias("distance"), "rank")


def scratch_index_path(spark: SparkSession, label: str) -> str:
    """A new folder for an index that lives as long as the application's other working tables."""
    from weftgraph.storage import scratch_dir

    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
