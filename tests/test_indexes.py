"""Stored vector and text indexes against exhaustive search, their updates, and what a search reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import search, text_index, vector_index
from weftgraph.operators.text_index import TextIndex
from weftgraph.operators.vector_index import VectorIndex

DIMS = 32
VECTOR = "id long, vector array<float>"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, DIMS))
    x = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, DIMS))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(None, rows[0][1]), (5000, None), (5001, [0.0] * DIMS), (5002, rows[7][1]), (5003, rows[7][1])]
    return spark.createDataFrame(rows, VECTOR)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.id, round(r.distance, 7)))
    return {q: sorted(v) for q, v in out.items()}


def test_vector_index(spark, vectors, tmp_path):
    queries = vectors.where("id % 50 = 7 or id = 5001").select(F.col("id").alias("query_id"), "vector")
    true = found(search.nearest(vectors, queries, 10))
    index = VectorIndex.create(vectors, f"{tmp_path}/v", lists=40)
    assert index.rows().count() == 3002
    quick = found(index.search(queries, 10, probes=8))
    hits = sum(len({i for _, i, _ in true[q]} & {i for _, i, _ in quick[q]}) for q in true)
    assert hits >= 0.9 * sum(map(len, true.values()))
    assert found(index.search(queries, 10, probes=2, rerank=1, complete=True)) == true
    assert found(VectorIndex(spark, f"{tmp_path}/v").search(queries, 10, probes=40, rerank=400)) == true
    # a search reads the lists it probes and no other folder
    one = queries.where("query_id = 7")
    lists = {r["list"] for r in index._pairs(one.withColumn("bound", F.lit(0.0)).select("query_id", F.col("vector").cast("array<double>").alias("vector"), "bound"), 2).collect()}
    read = index.rows().where(F.col("list").isin(sorted(lists))).select("id", "code")
    assert len(lists) == 2 and "PartitionFilters: [" in read._jdf.queryExecution().toString() and {f.split("list=")[1].split("/")[0] for f in read.inputFiles()} <= {str(i) for i in range(40)}
    # rows that come later are found, also where the list is cut in pieces and queries in blocks
    index.add(spark.createDataFrame([(9000, [float(x) for x in np.ones(DIMS)])], VECTOR))
    more = spark.createDataFrame([(1, [float(x) for x in np.ones(DIMS)])], "query_id long, vector array<float>")
    assert [x[1] for x in found(index.search(more, 3))[1]][0] == 9000
    index.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        VectorIndex(spark, f"{tmp_path}/v")
    with pytest.raises(ValueError, match="no vectors"):
        VectorIndex.create(vectors.where("id < 0"), f"{tmp_path}/none")


def test_vector_index_in_pieces(vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "LIST_ROWS", 64)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 8)
    queries = vectors.where("id % 40 = 3").select(F.col("id").alias("query_id"), "vector")
    index = VectorIndex.create(vectors, f"{tmp_path}/v", lists=3, parts=4)
    assert found(index.search(queries, 5, probes=3, rerank=3, complete=True)) == found(search.nearest(vectors, queries, 5))


TEXT = "id long, text string"


def texts(rng, n):
    words = ["the", "a", "reading", "thing", "pathetic", "Über", "x9", *(f"w{i}" for i in range(60))]
    weights = [30, 20, 2, 2, 1, 1, 1, *([1] * 60)]
    return [(i, None if i % 53 == 0 else " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 8, 40])))) for i in range(n)]


def ranking(df):
    return [(r.id, r.score) for r in df.collect()]


@pytest.mark.parametrize("window", [16, 1024])
def test_text_index_equals_scan(spark, tmp_path, monkeypatch, window):
    monkeypatch.setattr(text_index, "WINDOW", window)
    rows = texts(random.Random(window), 600) + [(None, "reading"), (3, "reading thing"), (3, "pathetic")]
    docs = spark.createDataFrame(rows, TEXT).repartition(5)
    index = TextIndex.create(docs, f"{tmp_path}/t")
    for query, ks in (("Reading the THING, pathetic", (1, 10, 1000)), ("w1 w2 absent", (10,)), ("absent", (10,)), ("...", (10,))):
        want = ranking(search.bm25(docs.where("id is not null"), query)) if query != "..." else []
        for k in ks:
            assert ranking(index.search(query, k)) == want[:k], (query, k)


def test_text_index_updates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "WINDOW", 32)
    rng = random.Random(1)
    rows = dict(texts(rng, 400))
    index = TextIndex.create(spark.createDataFrame(list(rows.items()), TEXT), f"{tmp_path}/t")
    changed = {i: f"{t or ''} reading reading" for i, t in rows.items() if i % 10 == 3} | {1000: "a new thing", 1001: None}
    index.replace(spark.createDataFrame(list(changed.items()), TEXT))
    index.remove(spark.createDataFrame([(5,), (6,), (6,), (7777,), (None,)], "id long"))
    index.remove(spark.createDataFrame([(5,)], "id long"))
    rows = {i: t for i, t in (rows | changed).items() if i not in (5, 6)}
    now = spark.createDataFrame(list(rows.items()), TEXT)
    for query in ("reading thing", "w3 pathetic new the"):
        assert ranking(index.search(query, 25)) == ranking(search.bm25(now, query, limit=25))
    want = {}
    for t in rows.values():
        for w in set(text_index.query_terms(t or "")):
            want[w] = want.get(w, 0) + 1
    assert {r.term: r.df for r in text_index.indexed_terms(index).collect()} == want
    index.drop()


def test_text_index_reads_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "WINDOW", 16)
    rng = random.Random(9)
    rows = texts(rng, 1500) + [(5000 + i, "reading " * 30) for i in range(3)]
    index = TextIndex.create(spark.createDataFrame(rows, TEXT), f"{tmp_path}/t")
    files = index.postings(["reading"]).inputFiles()
    every = index._read("blocks", text_index.BLOCKS)
    plan = index.postings(["reading"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "reading" in plan
    assert files and index.postings(["reading"]).count() < every.count() / 10
    windows = every.where("term = 'reading'").select("win").distinct().count()
    assert index.windows_scored("reading", 3) < windows / 2


def test_text_index_empty(spark, tmp_path):
    index = TextIndex.create(spark.createDataFrame([], TEXT), f"{tmp_path}/t")
    assert ranking(index.search("reading", 5)) == []
    index.add(spark.createDataFrame([(1, "Reading")], TEXT))
    assert [i for i, _ in ranking(index.search("reading", 5))] == [1]
