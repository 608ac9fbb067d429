"""Operators on small hand-made graphs and files."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import routes, text
from weftgraph.operators import community, contracts, hierarchy, pattern, search, traverse
from weftgraph.operators.components import connected_components
from weftgraph.sources import code, files
from weftgraph.streaming import incremental


def edges_of(spark, pairs, kind="CALLS", confidence=0.9):
    return spark.createDataFrame([(f"{kind}:{a}->{b}", a, b, kind, confidence if len(r) == 2 else r[2], None) for r in pairs for a, b in [r[:2]]], "id string, src string, dst string, type string, confidence double, step int")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_bfs_cycles_confidence_and_skips(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "x", 0.3), ("x", "y"), ("d", "a")])
    depth = lambda df: {r.node: r.depth for r in df.collect()}
    assert depth(traverse.bfs(ids(spark, "a"), e, 3)) == {"b": 1, "x": 1, "c": 2, "y": 2, "d": 3}
    assert depth(traverse.bfs(ids(spark, "a"), e, 3, min_confidence=0.5)) == {"b": 1, "c": 2, "d": 3}
    assert depth(traverse.bfs(ids(spark, "c"), e, 1, "in")) == {"b": 1}
    assert depth(traverse.bfs(ids(spark, "a"), e, 0, skip=ids(spark, "b"))) == {"x": 1, "y": 2}
    assert traverse.bfs(ids(spark, "zz"), e, 2).count() == 0


def test_neighbourhood(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("z", "a"), ("c", "a"), ("q", "r")])
    near, inside = traverse.neighbourhood(ids(spark, "a"), e, 2)
    assert {r.node: r.depth for r in near.collect()} == {"a": 0, "b": 1, "c": -1, "z": -1}
    assert inside.count() == 4


def test_paths_and_subpaths(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("a", "e", 0.2)])
    paths = traverse.enumerate_paths(ids(spark, "a", "b"), e)
    assert {tuple(r.path) for r in paths.collect()} == {("a", "b", "c"), ("a", "b", "d", "e"), ("b", "c", "a"), ("b", "d", "e")}
    kept = traverse.drop_subpaths(spark.createDataFrame([("a", ["a", "b"]), ("a", ["a", "b", "c"]), ("a", ["a", "c"])], "entry string, path array<string>"))
    assert {(r.terminal, tuple(r.path)) for r in kept.collect()} == {("c", ("a", "b", "c"))}


def test_topological_levels_with_a_cycle(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")])
    got = {r.node: r.level for r in traverse.topological_levels(ids(spark, *"abcxyz"), e).collect()}
    assert got == {"c": 0, "b": 1, "a": 2, "x": -1, "y": -1, "z": -1}


def test_components_brute_force(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 380)] + [(500, k) for k in range(501, 560)] + [(None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_communities_split_cliques(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    m = community.communities(edges_of(spark, clique("a") + clique("b") + [("a0", "b0"), ("p", "q")]))
    got = {r.node: r.community for r in m.collect()}
    assert {got[f"a{i}"] for i in range(5)} == {"a0"} and {got[f"b{i}"] for i in range(5)} == {"b0"} and got["p"] == got["q"]
    c = {r.community: (r.size, r.cohesion) for r in community.cohesion(edges_of(spark, clique("a") + clique("b") + [("a0", "b0")]), m).collect()}
    assert c["a0"] == (5, round(20 / 21, 6)) and c["p"] == (2, 1.0)


def test_c3_and_overrides(spark):
    rows = [("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("X", "P", 0), ("X", "Q", 1), ("Y", "Q", 0), ("Y", "P", 1), ("Z", "X", 0), ("Z", "Y", 1), ("L", "L2", 0), ("L2", "L", 0)]
    mro = hierarchy.linearise(spark.createDataFrame(rows, "cls string, parent string, pos int"))
    got = {r.cls: r.mro for r in mro.collect()}
    assert got["D"] == ["D", "B", "C", "A"] and got["Z"] is None and got["L"] is None
    methods = spark.createDataFrame([("B", "run", "Method"), ("C", "run", "Method"), ("A", "go", "Method"), ("C", "p", "Property"), ("B", "p", "Property")], "owner string, method string, kind string")
    assert [tuple(r) for r in hierarchy.overrides(mro, methods).collect()] == [("D", "run", "B", 0.9)]
    extends = spark.createDataFrame([r[:2] for r in rows], "cls string, parent string")
    assert hierarchy.inherited(ids(spark, "D"), extends, methods, "go").first().owner == "A"
    assert hierarchy.inherited(ids(spark, "D"), extends, methods, "run").count() == 0
    impl = hierarchy.implementations(spark.createDataFrame([("K", "I")], "cls string, iface string"), spark.createDataFrame([("K", "f", 1), ("I", "f", 1), ("K", "g", None), ("I", "g", 2), ("K", "h", 1), ("I", "h", 2)], "owner string, method string, arity int"))
    assert {(r.method, r.confidence) for r in impl.collect()} == {("f", 1.0), ("g", 0.7)}


def test_routes_and_contracts(spark):
    f = spark.createDataFrame([(1, "/api/users/42?x=1"), (2, "/api/${id}/posts"), (3, "get() + x"), (4, "/docs/a/b/c"), (5, "/api/users.php")], "fetch_id int, url string")
    r = spark.createDataFrame([(10, "/api/users/[id]", 0), (11, "/api/users", 1), (12, "/api/[x]/posts", 2), (13, "/docs/[...rest]", 3), (14, "/docs/a/b/c", 4)], "route_id int, route string, seq int")
    assert {x.fetch_id: x.route_id for x in contracts.match_routes(f, r).collect()} == {1: 10, 2: 10, 4: 13, 5: 11}  # a wildcard on either side fits any segment
    rows = [
        ("a", "http::get::/x/", "provider", "p1", None, 0.9), ("b", "http::GET::/x", "consumer", "c1", None, 0.8), ("a", "http::GET::/x", "consumer", "c2", None, 0.8),
        ("b", "http::*::/x", "consumer", "c3", None, 0.7), ("a", "grpc::pkg.Users/Login", "provider", "p2", None, 0.9), ("c", "grpc::users/*", "consumer", "c4", None, 0.6),
        ("a", "http::GET::/x", "consumer", "c5", "s2", 0.8),
    ]
    links = contracts.match_contracts(spark.createDataFrame(rows, "repo string, contractId string, role string, symbolUid string, service string, confidence double"))
    assert {(x.fromSymbolUid, x.toSymbolUid, x.matchType, x.confidence) for x in links.collect()} == {("c1", "p1", "exact", 1.0), ("c3", "p1", "wildcard", 0.7), ("c4", "p2", "wildcard", 0.6)}
    got = spark.createDataFrame([("http::get::/a//",), ("grpc::Pkg.S/Do",), ("grpc::/Do",), ("topic:: A ",), ("lib::X",), ("odd",)], "c string").select(routes.contract_id(F.col("c")).alias("c"))
    assert [x.c for x in got.collect()] == ["http::GET::/a", "grpc::pkg.s/Do", "grpc::/Do", "topic::a", "lib::x", "odd"]
    t = spark.createDataFrame([(1, "a.b.c"), (2, "x${y}"), (3, "q-r")], "transport_id int, topic string")
    lis = spark.createDataFrame([(7, "a.b"), (8, "q-r"), (9, "a.bc")], "listener_id int, topic string")
    assert {tuple(x) for x in contracts.match_topics(t, lis).collect()} == {(1, 7), (3, 8)}
    cfg = spark.createDataFrame([({"A.b": "1"}, "x ${a.B:9} ${none:7} ${zip}!")], "m map<string,string>, t string")
    assert cfg.select(routes.resolve_placeholders(F.col("t"), F.col("m")).alias("r")).first().r == "x 1 7 !"


def test_overlap_is_binned_and_exact(spark):
    rng = random.Random(2)
    a = [(rng.choice("xy"), s, s + rng.randint(0, 300)) for s in (rng.randint(0, 900) for _ in range(40))]
    b = [(rng.choice("xy"), s, s + rng.randint(0, 300)) for s in (rng.randint(0, 900) for _ in range(40))]
    got = pattern.overlapping(spark.createDataFrame(a, "k string, r_start long, r_end long"), spark.createDataFrame(b, "k string, s_start long, s_end long"), "k", 64).count()
    assert got == sum(x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2] for x in a for y in b)


def test_nearest_brute_force(spark):
    rng = random.Random(3)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(900, [0.0] * 8), (901, None)]
    df = spark.createDataFrame(v, "id long, vector array<double>")
    got = search.nearest(df, df.where("id % 10 = 0").withColumnRenamed("id", "query_id"), 4, block=5)
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q in range(0, 120, 10):
        want = sorted((round(cos(v[q][1], x), 9), i) for i, x in v[:120])[:4]
        assert [(r.id) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == [i for _, i in want]


def test_text_functions(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert row(text.is_test_path(F.lit("src\\tests\\A.py"))) and not row(text.is_test_path(F.lit("src/latest/a.py")))
    assert row(text.camel_to_kebab(F.lit("getUserName"))) == "get-user-name" and row(text.sanitize_id(F.lit("A b--C"))) == "a_b_c"
    assert row(text.capitalize(F.lit("abc"))) == "Abc" and row(text.sanitize(F.lit("a\r\nb\x00"))) == "a\nb"
    assert row(text.reason_fetches(F.lit("x|keys:a,b|fetches:3"))) == 3 and row(text.reason_fetches(F.lit("x"))) == 1
    assert [c.start for c in row(text.chunks(F.lit("x" * 2500)))] == [0, 1080, 2160] and len(row(text.chunks(F.lit("")))) == 1
    assert row(routes.file_route(F.lit("src/app/(admin)/api/users/route.ts"))) == "/api/users" and row(routes.file_route(F.lit("pages/api/a/index.ts"))) == "/api/a"
    assert row(text.short_description(F.lit("One sentence is here. " * 12))).endswith(".")


def test_diffs_config_and_graph_tables(spark, tmp_path):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n+a\n@@ -9,2 +9,0 @@\n--- a/y\n+++ b/y\n@@ -3 +4 @@\n".split("\n")
    got = files.diff_hunks(spark.createDataFrame([(1, k, line) for k, line in enumerate(diff)], "diff int, n int, line string"))
    assert [(r.filePath, r.startLine, r.endLine) for r in got.orderBy("filePath").collect()] == [("x", 1, 3), ("y", 4, 4)]
    n = spark.createDataFrame([("File:a", "File", "a"), ("Function:f", "Function", "a"), ("File:b", "File", "b")], "id string, label string, filePath string")
    e = edges_of(spark, [("File:a", "Function:f"), ("File:a", "gone"), ("File:b", "File:a")])
    assert files.write_graph(n, e, f"{tmp_path}/g") == {"nodes": 3, "edges": 2, "skipped": 1}
    nodes, edges = files.read_graph(spark, f"{tmp_path}/g")
    left, rest = files.delete_file(nodes, edges, "a")
    assert left.count() == 1 and rest.count() == 0 and sum(1 for _ in files.ndjson(nodes, edges)) == 5
    up = files.upsert(n, spark.createDataFrame([("File:b", "File", "c"), ("File:d", "File", "d")], n.schema))
    assert {r.id: r.filePath for r in up.collect()}["File:b"] == "c" and up.count() == 4
    assert files.markdown_table(n.orderBy("id"), 1).count("\n") == 2


def test_walk_and_parse(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/a.py").write_text("from pkg import b\n\nclass K(Base):\n    def run(self, x):\n        return helper(x)\n\ndef helper(v):\n    return b.work(v)\n")
    (tmp_path / "pkg/b.py").write_text("def work(v):\n    return v\n")
    (tmp_path / "node_modules/x.js").write_text("function no() {}")
    (tmp_path / "r.md").write_text("# A\ntext [l](pkg/a.py)\n## B\n")
    (tmp_path / "s.ts").write_text("export class S extends T {\n}\napp.get('/api/x', h)\nfetch('/api/x')\n")
    found = files.walk(spark, str(tmp_path))
    facts = code.parse(found).cache()
    assert found.count() == 4 and {r.name for r in code.symbols(facts).collect()} >= {"K", "run", "helper", "work", "S", "A", "B"}
    paths = found.select("path")
    imports = code.resolve_imports(facts, paths)
    calls = code.resolve_calls(facts, imports).collect()
    assert {(r.dst.rsplit(":", 1)[-1], r.confidence) for r in calls} >= {("helper", 0.95)}
    assert {r.kind for r in facts.collect()} >= {"extends", "route", "fetch", "link", "Section"}
    assert files.grep(found, "RETURN").count() == 3
    facts.unpersist()


def test_stream_upsert_and_windows(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a", "1"), ("b", "1")], "id string, v string").coalesce(1).write.parquet(src)
    for more in (None, [("a", "2")]):
        if more:
            spark.createDataFrame(more, "id string, v string").coalesce(1).write.mode("append").parquet(src)
        q = incremental.upsert_batches(spark.readStream.schema("id string, v string").parquet(src), f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination(60)
    assert {r.id: r.v for r in incremental.newest(spark, f"{tmp_path}/out").collect()} == {"a": "2", "b": "1"}
    rows = [("a", "9", 1), ("a", "3", 2), ("a", "4", 2), ("b", None, None), ("b", "0", None), (None, "7", 1)]
    kind = "id string, v string, seq int"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/seq")
    for out, order, want in (("o1", "seq", {"a": "4", "b": "0", None: "7"}), ("o2", None, {"a": "9", "b": "0", None: "7"})):
        q = incremental.upsert_batches(spark.readStream.schema(kind).parquet(f"{tmp_path}/seq"), f"{tmp_path}/{out}", f"{tmp_path}/cp-{out}", order=order)
        q.awaitTermination(60)
        assert {r.id: r.v for r in spark.read.parquet(f"{tmp_path}/{out}").collect()} == want


@pytest.mark.parametrize("n,want", [(0, "none"), (5, "low"), (15, "medium"), (16, "high")])
def test_change_risk(spark, n, want):
    assert spark.range(1).select(contracts.change_risk(F.lit(n)).alias("r")).first().r == want
