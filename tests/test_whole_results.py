"""Results that must not end at a size."""

import numpy as np

from weftgraph.operators import compose, contracts, hierarchy, search, traverse
from weftgraph.plans import queries
from weftgraph.sources import code
from weftgraph.storage import bounded_broadcast


def test_more_query_vectors_than_ten_thousand(spark, tmp_path):
    n = 1_000_200
    rng = np.random.default_rng(2)
    spark.range(n).selectExpr("id as vec_id", "array(float(cos(id)), float(sin(id))) as embedding").where("vec_id % 100 = 0 or vec_id < 300").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.cosine_threshold(spark, str(tmp_path))
    assert got.count() == 10_002
    few = {r.query_id: r.n for r in got.where("query_id < 300").collect()}
    k = np.array([i for i in range(n) if i % 100 == 0 or i < 300])
    x = np.stack([np.cos(k), np.sin(k)], 1).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert few == {i: int((np.round(1 - x @ x[np.searchsorted(k, i)], 9) < 0.6).sum()) for i in (0, 100, 200)}
    v = spark.createDataFrame([(k, [float(a) for a in rng.normal(size=3)]) for k in range(50)] + [(50, None), (51, [0.0] * 3)], "id long, vector array<double>")
    q = v.selectExpr("id as query_id", "vector")
    assert sorted(search.within(v, q, 0.6, block=7).collect()) == sorted(search.within(v, q, 0.6).collect())
    assert search.within(v, q.limit(0), 0.6).count() == 0


def test_imports_of_many_segments(spark):
    deep = "src/main/java/com/a/b/c/d/e/f/g/h/Deep.java"
    files = spark.createDataFrame([(deep,), ("x/h/Deep.java",), ("src/Main.java",), ("lib/util/__init__.py",)], "path string")
    facts = spark.createDataFrame([("src/Main.java", "import", t) for t in ("com.a.b.c.d.e.f.g.h.Deep", "src.main.java.com.a.b.c.d.e.f.g.h.Deep", "h.Deep", "..util", "no.such.Thing")], "path string, kind string, target string")
    got = {(r.src, r.dst) for r in code.resolve_imports(facts, files).collect()}
    assert got == {("File:src/Main.java", f"File:{p}") for p in (deep, "x/h/Deep.java", "lib/util/__init__.py")}
    assert code.resolve_imports(facts.where("path = ''"), files).count() == 0


def test_more_levels_than_a_hundred(spark):
    chain = spark.range(1, 103).selectExpr("cast(id as string) as src", "cast(id - 1 as string) as dst").unionByName(spark.createDataFrame([("x", "y"), ("y", "x")], "src string, dst string"))
    nodes = chain.selectExpr("explode(array(src, dst)) as id")
    got = {r.node: r.level for r in traverse.topological_levels(nodes, chain).collect()}
    assert got == {str(k): k for k in range(103)} | {"x": -1, "y": -1}


def test_c3_needs_no_whole_hierarchy(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", lambda *a: seen.append(a), raising=False)
    pairs = [("B", "A", 0), ("C", "A", 0), ("D", "B", 0), ("D", "C", 1), ("E", "C", 0), ("E", "B", 1), ("F", "D", 0), ("F", "E", 1), ("x", "y", 0), ("y", "x", 0), ("z", "x", 0), ("s", "s", 0), ("G", "F", 0)]
    got = {r.cls: r.mro for r in hierarchy.linearise(spark.createDataFrame(pairs, "cls string, parent string, pos int")).collect()}
    want = {"A": "A", "B": "BA", "C": "CA", "D": "DBCA", "E": "ECBA", "F": None, "G": None, "x": None, "y": None, "z": None, "s": None}
    assert got == {k: v and list(v) for k, v in want.items()} and not seen


def test_broadcast_sides_are_bounded_in_rows_and_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    side = spark.createDataFrame([(k, "x" * 1000, None) for k in range(50)], "id long, text string, other string")
    assert hinted(bounded_broadcast(side)) and hinted(bounded_broadcast(side.limit(0)))
    assert not hinted(bounded_broadcast(side, rows=49)) and not hinted(bounded_broadcast(side, size=50_000))


def test_paths_stop_at_three_times_branching(spark):
    nodes = [f"n{i}" for i in range(6)]
    edges = spark.createDataFrame([(a, b, 0.9, i) for a in nodes for i, b in enumerate(nodes) if a != b], "src string, dst string, confidence double, step int")
    got = [tuple(r.path) for r in traverse.enumerate_paths(spark.createDataFrame([("n0",)], "id string"), edges, branching=2).collect()]

    def plain(limit):
        queue, out = [("n0",)], []
        while queue and len(out) < limit:
            path = queue.pop(0)
            more = [b for b in [x for x in nodes if x != path[-1]][:2] if b not in path]
            if not more or len(path) == 10:
                out.append(path)
            queue += [] if len(path) == 10 else [(*path, b) for b in more]
        return out

    assert sorted(got) == sorted(plain(6))


def test_bubble_up_climbs_only_while_open(spark):
    calls = spark.createDataFrame([(f"c{i:02d}", "s") for i in range(30)] + [("far", "c00"), ("farther", "far")], "src string, dst string")
    sinks = spark.createDataFrame([("k", "s"), ("k2", "c00")], "sink string, node string")
    late = spark.createDataFrame([("c25", "hidden", 0.9), ("far", "x", 0.5), ("farther", "y", 0.9)], "node string, value string, confidence double")
    assert {tuple(r) for r in compose.bubble_up(sinks, calls, late).collect()} == {("k", "x", 0.5, 2), ("k2", "x", 0.5, 1)}


def test_tails_fall_back_on_prefixes(spark):
    t = spark.createDataFrame([(1, "/FOService1"), (2, "/api/long-enough"), (3, "/none-of-them")], "transport_id int, path string")
    r = spark.createDataFrame([(10, "/foservice1/sendMessage"), (11, "/x/api/long-enough"), (12, "/api/long-enough/more"), (13, "/other")], "route_id int, route string")
    assert {tuple(x) for x in contracts.match_tails(t, r).collect()} == {(1, 10, "foservice1"), (2, 11, "api/long-enough")}
