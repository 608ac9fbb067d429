"""Symbol views, source scans, stems and searches on small hand-made graphs and texts."""

from pyspark.sql import functions as F

from weftgraph.functions import shapes
from weftgraph.functions.stems import porter
from weftgraph.operators import context, search
from weftgraph.plans import queries_tools  # noqa: F401  (registers its queries for test_queries)


def test_porter_stems():
    want = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall",
        "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good",
        "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "is": "is", "é": "é", "a1": "a1",
    }
    assert {w: porter(w) for w in want} == want


def test_stemmed_search_over_two_fields(spark):
    docs = spark.createDataFrame([(1, "walking the dogs", "runner"), (2, "nothing", "walks"), (3, None, "cat"), (4, "walked walked", None)], "id long, text string, name string")
    got = {r.id: r.score for r in search.bm25_fields(docs, "walked", ["text", "name"]).collect()}
    assert set(got) == {1, 2, 4} and got[4] > got[1] and search.bm25_fields(docs.limit(0), "x", ["text"]).count() == 0


def test_class_context_shows_callers_of_constructor_and_file(spark):
    nodes = spark.createDataFrame([("C", "Class", "C", "f"), ("C.new", "Constructor", "new", "f"), ("f", "File", "f", "f"), ("a", "Function", "a", "g"), ("b", "File", "b", "b")], "id string, label string, name string, filePath string")
    edges = spark.createDataFrame([("C", "C.new", "HAS_METHOD", 1), ("f", "C", "DEFINES", 1), ("a", "C.new", "CALLS", 1), ("b", "f", "IMPORTS", 1), ("a", "C", "EXTENDS", 1), ("a", "P", "STEP_IN_PROCESS", 2)], "src string, dst string, type string, step int")
    me = spark.createDataFrame([("C",)], "id string")
    got = {(r.direction, r.type, r.other) for r in context.context(me, nodes, edges).collect()}
    assert got == {("in", "EXTENDS", "a"), ("in", "CALLS", "a"), ("in", "IMPORTS", "b"), ("out", "HAS_METHOD", "C.new")}
    p = spark.createDataFrame([("P", "Flow", 3)], "id string, heuristicLabel string, stepCount int")
    assert [tuple(r) for r in context.participation(nodes, p, edges).collect()] == [("a", "P", "Flow", 2, 3)]


def test_augment_ranks_by_cohesion(spark):
    nodes = spark.createDataFrame([("m1", "loginUser", "a.ts"), ("m2", "loginForm", "b.ts"), ("m3", "other", "a.ts")], "id string, name string, filePath string")
    files = spark.createDataFrame([("a.ts", "login login page"), ("b.ts", "login form"), ("c.ts", "none")], "filePath string, text string")
    edges = spark.createDataFrame([("m3", "m1", "CALLS", None), ("m1", "m2", "CALLS", None), ("m1", "k", "MEMBER_OF", None), ("m2", "l", "MEMBER_OF", None), ("m2", "p", "STEP_IN_PROCESS", 1)], "src string, dst string, type string, step int")
    com = spark.createDataFrame([("k", 0.2), ("l", 0.9)], "id string, cohesion double")
    proc = spark.createDataFrame([("p", "Flow", 4)], "id string, heuristicLabel string, stepCount int")
    got = context.augment("login page", files, nodes, edges, com, proc).collect()
    assert [(r.id, r.callers, r.callees, r.flows) for r in got] == [("m2", ["loginUser"], [], ["Flow (step 1/4)"]), ("m1", ["other"], ["loginForm"], [])]
    assert not context.augment("", files, nodes, edges, com, proc).collect()


def test_unit_chunks_cover_the_text_along_statements():
    body = "function f() {\n" + "".join(f"  const v{k} = call({k});\n" for k in range(120)) + "}\n"
    got = shapes.unit_chunks(body, 400, 60)
    assert got[0]["start"] == 0 and got[-1]["end"] == len(body) and all(c["end"] - c["start"] <= 400 for c in got)
    assert all(a["end"] >= b["start"] - 3 for a, b in zip(got, got[1:])) and all(body[c["start"] : c["start"] + 5] in ("funct", "const") for c in got)
    assert shapes.unit_chunks("x", 10) == [{"chunk": 0, "start": 0, "end": 1}] and shapes.unit_chunks("") == [{"chunk": 0, "start": 0, "end": 0}]
    long = shapes.unit_chunks("def f():\n    x = '" + "y" * 3000 + "'\n    return 1", 1000, 100)
    assert len(long) >= 3 and long[-1]["end"] == 3000 + len("def f():\n    x = ''\n    return 1")
