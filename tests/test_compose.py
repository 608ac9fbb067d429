"""Composed tools on small graphs."""

import json

from weftgraph.operators import compose
from tests.test_operators import edges_of


def test_processes(spark):
    names = ["handleLogin", "check", "load", "save", "helperUtil"]
    nodes = spark.createDataFrame([(n, "Function", n, "src/a.ts", n == "handleLogin") for n in names] + [("t", "Function", "t", "x/tests/t.ts", True)], "id string, label string, name string, filePath string, isExported boolean")
    edges = edges_of(spark, [("handleLogin", "check"), ("check", "load"), ("load", "save"), ("t", "handleLogin"), ("save", "check"), ("helperUtil", "save", 0.3)])
    members = spark.createDataFrame([("handleLogin", "c0"), ("check", "c0"), ("load", "c1"), ("save", "c1")], "node string, community string")
    starts = {r.id: r.score for r in compose.entry_points(nodes, edges).collect()}
    assert "t" not in starts and starts["handleLogin"] == 1 / 2 * 2 * 1.5
    procs, steps = compose.detect_processes(nodes, edges, members)
    first = next(r for r in procs.collect() if r.entry == "handleLogin")
    assert (first.terminal, first.stepCount, first.processType, first.label) == ("save", 4, "cross_community", "HandleLogin → Save")
    assert {(r.node, r.step) for r in steps.where(steps.process == first.id).collect()} == {("handleLogin", 1), ("check", 2), ("load", 3), ("save", 4)}


def test_cycles_and_values(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "x")])
    assert {r.node: r.component for r in compose.strongly_connected(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    sinks = spark.createDataFrame([("s1", "d"), ("s2", "y"), ("s3", "q")], "sink string, node string")
    values = spark.createDataFrame([("c", "near", 0.8), ("b", "far", 0.95), ("x", "v1", 0.5), ("x", "v2", 0.9)], "node string, value string, confidence double")
    assert {tuple(r) for r in compose.bubble_up(sinks, e, values).collect()} == {("s1", "near", 0.8, 1), ("s2", "v2", 0.9, 1)}


def test_rules_contracts_links(spark):
    nodes = spark.createDataFrame([("M:1", "Method", "onEvent"), ("M:2", "Method", "other"), ("C:1", "Class", "QueueListener")], "id string, label string, name string")
    edges = edges_of(spark, [("C:1", "M:1"), ("C:1", "M:2")], "HAS_METHOD")
    rule = {"start": {"label": "Method", "where": {"name": {"matches": "^on"}}}, "steps": [{"types": ["HAS_METHOD"], "direction": "in"}], "end": {"where": {"name": {"contains": "Listener"}}}, "emit": {"label": "Listener", "id": "listener:${end.name}:${start.name}"}}
    assert [tuple(r) for r in compose.apply_rule(nodes, edges, json.dumps(rule)).collect()] == [("listener:QueueListener:onEvent", "Listener", "M:1")]
    facts = spark.createDataFrame([("s.ts", "route", "GET", "S", "/api/Users/:id"), ("w.ts", "fetch", "", "W", "/api/users/42?x=1")], "path string, kind string, name string, owner string, target string")
    got = {(r.contractId, r.role) for r in compose.http_contracts(facts, "r").collect()}
    assert got == {("http::GET::/api/users/{param}", "provider"), ("http::*::/api/users/{param}", "consumer")}
    links = spark.createDataFrame([("docs/a.md", "../src/x.py"), ("docs/a.md", "./b.md"), ("docs/a.md", "gone.md")], "path string, target string")
    paths = spark.createDataFrame([("src/x.py",), ("docs/b.md",)], "path string")
    assert {tuple(r) for r in compose.resolve_links(links, paths).collect()} == {("docs/a.md", "src/x.py", 0.8), ("docs/a.md", "docs/b.md", 0.8)}


def test_registry_parity_either(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"repo": "a", "commit": "1"}, {"repo": "b", "commit": "2"}]))
    heads = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "repo string, head string")
    assert {tuple(r) for r in compose.is_current(compose.read_registry(spark, f"{tmp_path}/r.json"), heads).collect()} == {("a", True), ("b", False), ("c", False)}
    runs = spark.createDataFrame([("py", "x", "x"), ("py", "x", None), ("go", None, None)], "language string, old string, new string")
    assert {tuple(r) for r in compose.parity(runs).collect()} == {("py", 2, 1, 0.5), ("go", 1, 1, 1.0)}
    left, right = spark.createDataFrame([("f",), ("g",)], "k string"), spark.createDataFrame([("f", "f"), ("z", "g")], "path string, name string")
    assert compose.either_column(left, right, "k", ["path", "name"]).count() == 2
