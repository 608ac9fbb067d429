"""A stored full-text index with block maxima: BM25 top-k that reads the query's postings alone.

Documents get numbers as they are read and fall into windows of WINDOW numbers, each within one task; a block holds the
postings of one term in one window, with its largest term frequency and its shortest document. So blocks are whole when
a task hands them on, and only whole blocks are shuffled to their buckets. Layout below one folder:

* ``blocks`` - (bucket of the term) / term, win, offs (places in the window), tfs, lens, max_tf, min_len: sorted by term, partitioned by bucket
* ``terms`` - (bucket) / term, df: a row for each term and change, so document frequencies are sums of few rows
* ``docs`` - number, id, len
* ``removed`` - numbers of documents that are gone
* ``totals`` - documents and words, a row for each change

A query bounds every window by the sum over its terms of the best score that the block's largest frequency and shortest
document allow; the windows of largest bound give a first k-th score, and only windows whose bound reaches it are scored.
A window below it cannot hold one of the k best, so the answer is exact.

Null texts are empty; a null id is no document; rows of one id are one document; words are runs of a-z and 0-9 after
lower-casing; ties go by id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.search import B, K1
from weftgraph.storage import bounded_broadcast, delete_path, drop_table, write_table

#: Documents of a window, buckets of terms, and postings after which a task closes its window early.
WINDOW, BUCKETS, HELD = 1024, 64, 1_000_000
#: Windows whose documents set the first k-th score.
SEEDS = 4
#: What rounding to six digits may add to a score.
SLACK = 1e-6
#: Numbers of one change begin at a multiple of this, those of one task at a multiple of TASK.
CHANGE, TASK = 1 << 50, 1 << 33

BLOCKS = "bucket int, term string, win long, offs array<short>, tfs array<int>, lens array<int>, max_tf int, min_len int"
TERMS = "bucket int, term string, df long"
DOCS = "number long, id long, len int"
#: What a task hands on: a row of ``docs`` (term null) or of ``blocks``.
STAGED = "number long, id long, len int, term string, win long, offs array<short>, tfs array<int>, lens array<int>, max_tf int, min_len int"
#: Bytes of words stay, all others separate words.
WORD_BYTES = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def _stage(first: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the rows (id, lower-cased text) of a task and gathers their postings window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, lists, held = first + TaskContext.get().partitionId() * TASK, [], {}, 0

        def out() -> pa.RecordBatch:
            n, win = len(docs), docs[0][0] // window
            blank = [None] * n
            columns = [
                ([d[0] for d in docs] + [None] * len(lists), pa.int64()), ([d[1] for d in docs] + [None] * len(lists), pa.int64()), ([d[2] for d in docs] + [None] * len(lists), pa.int32()),
                (blank + [t.decode() for t in lists], pa.string()), (blank + [win] * len(lists), pa.int64()),
                (blank + [p[0] for p in lists.values()], pa.list_(pa.int16())), (blank + [p[1] for p in lists.values()], pa.list_(pa.int32())), (blank + [p[2] for p in lists.values()], pa.list_(pa.int32())),
                (blank + [max(p[1]) for p in lists.values()], pa.int32()), (blank + [min(p[2]) for p in lists.values()], pa.int32()),
            ]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["number", "id", "len", "term", "win", "offs", "tfs", "lens", "max_tf", "min_len"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if docs and (held >= HELD or number // window != docs[0][0] // window):
                    yield out()
                    number, docs, lists, held = -(-number // window) * window, [], {}, 0
                words = text.translate(WORD_BYTES).split()
                docs.append((number, doc, len(words)))
                for term, tf in Counter(words).items():
                    posting = lists.setdefault(term, ([], [], []))
                    posting[0].append(number % window)
                    posting[1].append(tf)
                    posting[2].append(len(words))
                    held += 1
                number += 1
        if docs:
            yield out()

    return run


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def query_terms(text: str) -> list[str]:
    """Distinct words of a query, as the index has them."""
    return sorted(set("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()))


class TextIndex:
    """An index stored below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    @classmethod
    def create(cls, docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> TextIndex:
        index = cls(docs.sparkSession, path)
        for part, schema in (("removed", "number long"), ("totals", "docs long, words long")):
            index.spark.createDataFrame([], schema).write.mode("errorifexists").parquet(f"{index.path}/{part}")
        index.add(docs, id_col, text_col)
        return index

    def add(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        """Store documents whose ids the index does not have. They fill new windows, so no stored block changes."""
        read = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), F.lower(F.coalesce(docs[text_col], F.lit(""))).alias("text"))
        twice = write_table(read.groupBy("id").count().where("count > 1").select("id"), "fts-twice")
        if not twice.isEmpty():
            several = bounded_broadcast(twice)
            merged = read.join(several, "id", "left_semi").groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
            read = read.join(several, "id", "left_anti").unionByName(merged)
        first = self._read("totals", "docs long, words long").count() * CHANGE
        staged = write_table(read.mapInArrow(_stage(first, WINDOW), STAGED), "fts-staged", compression="zstd")
        blocks = staged.where("term is not null")
        placed = blocks.select(bucket_of(F.col("term")).alias("bucket"), "term", "win", "offs", "tfs", "lens", "max_tf", "min_len")
        placed.repartitionByRange("bucket", "term", "win").sortWithinPartitions("bucket", "term", "win").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/blocks", compression="zstd")
        self._change_terms(blocks.groupBy("term").agg(F.sum(F.size("offs")).alias("df")))
        numbered = staged.where("term is null").select("number", "id", "len")
        numbered.write.mode("append").parquet(f"{self.path}/docs")
        numbered.agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).write.mode("append").parquet(f"{self.path}/totals")
        drop_table(staged)

    def _change_terms(self, change: DataFrame) -> None:
        rows = change.select(bucket_of(F.col("term")).alias("bucket"), "term", "df")
        rows.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/terms")

    def remove(self, ids: DataFrame, id_col: str = "id") -> None:
        """Take documents out: their numbers are listed, and frequencies and totals change. Stored blocks stay as they are."""
        gone = self._read("docs", DOCS).join(ids.select(ids[id_col].cast("long").alias("id")).distinct(), "id", "left_semi").join(self._read("removed", "number long"), "number", "left_anti")
        gone = write_table(gone, "fts-gone")
        windows = bounded_broadcast(gone.select(F.floor(F.col("number") / WINDOW).alias("win")).distinct())
        held = self._read("blocks", BLOCKS).select("term", "win", "offs").join(windows, "win", "left_semi").select("term", "win", F.explode("offs").alias("off")).select("term", (F.col("win") * WINDOW + F.col("off")).alias("number"))
        self._change_terms(held.join(gone.select("number"), "number", "left_semi").groupBy("term").agg((-F.count("*")).alias("df")))
        gone.agg((-F.count("*")).alias("docs"), (-F.coalesce(F.sum("len"), F.lit(0))).alias("words")).write.mode("append").parquet(f"{self.path}/totals")
        gone.select("number").write.mode("append").parquet(f"{self.path}/removed")

    def replace(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        """New texts for documents, known or not."""
        self.remove(docs, id_col)
        self.add(docs, id_col, text_col)

    def drop(self) -> None:
        """Delete the index."""
        delete_path(self.spark, self.path)

    def postings(self, wanted: list[str]) -> DataFrame:
        """Blocks of the wanted terms: only their buckets are read, and within these only row groups that may hold them."""
        return self._of(self._read("blocks", BLOCKS), wanted)

    def _of(self, stored: DataFrame, wanted: list[str]) -> DataFrame:
        buckets = self.spark.createDataFrame([(w,) for w in wanted], "term string").select(bucket_of(F.col("term"))).distinct().collect()  # a row for each word of the query
        return stored.where(F.col("bucket").isin([b[0] for b in buckets]) & F.col("term").isin(wanted))

    def _weights(self, wanted: list[str]) -> tuple[DataFrame, float]:
        """(term, idf) of the wanted terms, one row each, and the mean length."""
        about = self._read("totals", "docs long, words long").agg(F.sum("docs").alias("n"), F.sum("words").alias("words")).first()
        n, words = about["n"] or 0, about["words"] or 0
        df = self._of(self._read("terms", TERMS), wanted)
        df = df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), words / n if n else 1.0

    def _plan(self, wanted: list[str], k: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], float]:
        """Windows that may hold one of the k best documents, a function that scores the documents of windows, and the least score of interest."""
        idf, mean = self._weights(wanted)
        idf = F.broadcast(write_table(idf, "fts-idf"))  # a row for each word of the query
        blocks = self.postings(wanted)

        def part(tf: Column, length: Column) -> Column:
            return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(mean or 1.0))))

        most = blocks.select("term", "win", "max_tf", "min_len").join(idf, "term").select("win", part(F.col("max_tf"), F.col("min_len")).alias("most"))
        bounds = write_table(most.groupBy("win").agg(F.sum("most").alias("most")), "fts-bounds")
        removed = self._read("removed", "number long")

        def scored(windows: DataFrame) -> DataFrame:
            mine = blocks.select("term", "win", "offs", "tfs", "lens").join(bounded_broadcast(windows.select("win")), "win", "left_semi").join(idf, "term")
            flat = mine.select("idf", "win", F.explode(F.arrays_zip("offs", "tfs", "lens")).alias("p"))
            flat = flat.select("idf", (F.col("win") * WINDOW + F.col("p.offs")).alias("number"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
            each = flat.groupBy("number").agg(F.sum(part(F.col("tf"), F.col("len"))).alias("score"))
            return each.join(removed, "number", "left_anti")

        seeds = bounds.orderBy(F.desc("most"), "win").limit(SEEDS)
        first = scored(seeds).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        least = (first["least"] if first["n"] == k else 0.0) - SLACK
        return bounds.where(F.col("most") >= least), scored, least

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(id, score): the k best documents by BM25, best first, exactly."""
        wanted = query_terms(query)
        if not wanted:
            return self.spark.createDataFrame([], "id long, score double")
        windows, scored, least = self._plan(wanted, k)
        every = write_table(scored(windows).where(F.col("score") >= least), "fts-scored")
        # documents with one score are told apart by id, so ids join before the limit
        named = self._read("docs", DOCS).select("number", "id").join(bounded_broadcast(every), "number")
        return named.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def windows_scored(self, query: str, k: int = 10) -> int:
        """How many windows ``search`` scores in full, for measuring."""
        return self._plan(query_terms(query), k)[0].count()


def indexed_terms(index: TextIndex) -> DataFrame:
    """(term, df) of all terms that some document has."""
    return index._read("terms", TERMS).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
