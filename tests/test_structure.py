"""Strongly connected components, finalisation order, exported names and communities against plain versions."""

import itertools
import random
from collections import defaultdict

import pytest

from weftgraph.operators import bindings, community, components, types

EDGE = "src string, dst string"


def plain_components(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out.setdefault(b, set())

    def reach(a):
        seen, stack = set(), [a]
        while stack:
            for b in out[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        return seen

    far = {a: reach(a) for a in out}
    return {a: min([a, *(b for b in far[a] if a in far[b])]) for a in out}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(90):02d}", f"n{rng.randrange(90):02d}") for _ in range(110)]  # loops and repeats among them
    edges += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)] + [("c12", "c04"), ("a", "a")]
    got = components.strongly_connected(spark.createDataFrame([*edges, (None, "x"), ("x", None)], EDGE))
    assert {r.node: r.component for r in got.collect()} == plain_components(edges)
    assert components.strongly_connected(spark.createDataFrame([], EDGE)).count() == 0


def test_finalisation_order(spark):
    # app -> (a <-> b) -> base; other alone on a loop
    edges = [("app", "a"), ("a", "b"), ("b", "a"), ("b", "base"), ("app", "base"), ("other", "other")]
    got = {r.node: (r.component, r.level) for r in components.finalisation_order(spark.createDataFrame(edges, EDGE)).collect()}
    assert got == {"base": ("base", 0), "a": ("a", 1), "b": ("a", 1), "app": ("app", 2), "other": ("other", 0)}


def exports(spark, own, named, wild):
    frames = [spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)) for rows, cols in ((own, ["module", "name"]), (named, ["module", "name", "source", "source_name"]), (wild, ["module", "source"]))]
    return {(r.module, r.name): (r.origin, r.origin_name, r.hops, r.clash) for r in bindings.resolve_exports(*frames).collect()}


def test_export_chain_cycle_and_clash(spark):
    own = [("lib", "f"), ("lib", "default"), ("two", "f"), ("two", "g"), ("hides", "g"), (None, "h"), ("lib", "f")]
    named = [("barrel", "fn", "lib", "f"), ("top", "fn", "barrel", "fn"), ("a", "loop", "b", "loop"), ("b", "loop", "a", "loop"), ("hides", "g", "lib", "f"), ("top", "main", "lib", "default")]
    wild = [("star", "lib"), ("star", "two"), ("r1", "r2"), ("r2", "r1"), ("r2", "two"), ("hides", "two"), ("star", "star"), ("named_star", "barrel")]
    got = exports(spark, own, named, wild)
    assert got[("top", "fn")] == ("lib", "f", 2, False) and got[("top", "main")] == ("lib", "default", 1, False)
    assert got[("star", "f")] == ("lib", "f", 1, True)  # two definitions at one distance: the least, and a clash
    assert ("star", "default") not in got and got[("star", "g")] == ("two", "g", 1, False)
    assert got[("r1", "f")] == ("two", "f", 2, False) and got[("r2", "g")] == ("two", "g", 1, False)  # a cycle of wildcards ends
    assert got[("hides", "g")] == ("hides", "g", 0, False) and got[("hides", "f")] == ("two", "f", 1, False)
    assert ("a", "loop") not in got and ("b", "loop") not in got  # names that only point at each other stand for nothing
    assert got[("named_star", "fn")] == ("lib", "f", 2, False)
    assert exports(spark, [], named, wild) == {}


def test_long_export_chain(spark):
    named = [(f"m{i:02d}", "x", f"m{i - 1:02d}", "x") for i in range(1, 36)]
    got = exports(spark, [("m00", "x")], named, [])
    assert got == {(f"m{i:02d}", "x"): ("m00", "x", i, False) for i in range(36)}


def groups_of(members):
    out = defaultdict(set)
    for r in members.collect():
        out[r.community].add(r.node)
    return out


def connected(nodes, links):
    seen, stack = {min(nodes)}, [min(nodes)]
    while stack:
        a = stack.pop()
        for b in nodes - seen:
            if (a, b) in links or (b, a) in links:
                seen.add(b)
                stack.append(b)
    return seen == nodes


def test_ring_of_cliques(spark):
    edges = []
    for c in range(8):
        names = [f"c{c:02d}_{i}" for i in range(5)]
        edges += list(itertools.combinations(names, 2)) + [(names[0], f"c{(c + 1) % 8:02d}_1")]
    df = spark.createDataFrame(edges, EDGE)
    got = groups_of(community.communities(df))
    assert sorted(map(sorted, got.values())) == sorted(sorted(f"c{c:02d}_{i}" for i in range(5)) for c in range(8))
    assert all(name == min(nodes) for name, nodes in got.items())


def test_communities_are_connected_and_good(spark):
    rng = random.Random(4)
    block = {f"v{i:03d}": i % 5 for i in range(100)}
    edges = [(a, b) for a, b in itertools.combinations(block, 2) if rng.random() < (0.3 if block[a] == block[b] else 0.01)]
    df = spark.createDataFrame(edges, EDGE)
    members = community.communities(df).cache()
    links = set(edges)
    assert all(connected(nodes, links) for nodes in groups_of(members).values())
    planted = spark.createDataFrame([(v, str(c)) for v, c in block.items()], "node string, community string")
    assert community.modularity(df, members) >= community.modularity(df, planted) - 0.02
    assert community.communities(spark.createDataFrame([], EDGE)).count() == 0


def test_a_round_of_moves_is_one_job_without_shuffled_links(spark, monkeypatch):
    """Links are met by a link to itself and numbers, so a round writes one table, joins twice and gathers its sums on the way."""
    edges = [(f"s{i % 7}", f"p{i * i % 31}") for i in range(200)]
    seen, plain = [], community.write_table

    def noted(df, label, *more):
        if label == "moves":
            seen.append((df.dtypes, df._jdf.queryExecution().optimizedPlan().toString()))
        return plain(df, label, *more)

    monkeypatch.setattr(community, "write_table", noted)
    members = community.communities(spark.createDataFrame(edges, EDGE)).collect()
    assert seen and all(dict(types)["node"] == "bigint" and plan.count("Join ") <= 2 and "CollectMetrics" in plan for types, plan in seen)
    assert {r.node for r in members} == {v for e in edges for v in e} and all(r.community <= r.node for r in members)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize") != community.LEAST_PART


def planted_links():
    rng = random.Random(4)
    block = {f"v{i:03d}": i % 5 for i in range(100)}
    return block, [(a, b) for a, b in itertools.combinations(block, 2) if rng.random() < (0.3 if block[a] == block[b] else 0.01)]


def test_communities_write_few_tables(spark, monkeypatch):
    """Nodes of a block move one after the other in its task, so a level of one block takes one round, and few tables are written."""
    written, plain = [], community.write_table
    monkeypatch.setattr(community, "write_table", lambda df, label, *more: written.append(label) or plain(df, label, *more))
    block, edges = planted_links()
    found = groups_of(community.communities(spark.createDataFrame(edges, EDGE)))
    assert len(found) == 5 and all(len({block[v] for v in nodes}) == 1 for nodes in found.values())
    assert len(written) < 25 and written.count("moves") <= 6


def test_communities_over_many_blocks(spark, monkeypatch):
    """Small blocks, communities and a hub larger than a block: still connected, whole and good."""
    monkeypatch.setattr(community, "BLOCK_LINKS", 64)
    monkeypatch.setattr(community, "FAN_LINKS", 4)
    block, edges = planted_links()
    leaves = [("hub", f"leaf{i:02d}") for i in range(80)]
    edges += leaves + [("v000", "hub")]
    df = spark.createDataFrame(edges, EDGE)
    members = community.communities(df).cache()
    found, links = groups_of(members), set(edges)
    assert sorted(v for nodes in found.values() for v in nodes) == sorted({v for e in edges for v in e})
    assert all(connected(nodes, links) and name == min(nodes) for name, nodes in found.items())
    assert next(nodes for nodes in found.values() if "hub" in nodes) >= {b for _, b in leaves}
    planted = spark.createDataFrame([(v, str(c)) for v, c in block.items()] + [(v, "hub") for v in ["hub", *(b for _, b in leaves)]], "node string, community string")
    assert community.modularity(df, members) >= community.modularity(df, planted) - 0.02


@pytest.mark.parametrize("most", [1 << 20, 4])
def test_refinement_joins_over_links_only(spark, monkeypatch, most):
    """Parts of a community of two pieces keep to their pieces, whether it fits a task or not."""
    monkeypatch.setattr(community, "BLOCK_LINKS", most)
    pieces = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    rows = [(u, v, 1) for a, b in pieces for u, v in ((a, b), (b, a))] + [(v, v, 0) for v in range(6)]
    level = community._level(spark.createDataFrame([(u, v, w, 2, 2) for u, v, w in rows], "u long, v long, w long, k long, d long"))
    label = spark.createDataFrame([(v, 0, 2, 2) for v in range(6)], "node long, c long, k long, d long")
    parts, n = community._refined(level, label, 12.0, 1.0)
    got = {r.node: r.part for r in parts.collect()}
    assert n == len(set(got.values())) < 6 and all(got[p] == p and p // 3 == v // 3 for v, p in got.items())


def typed(spark, own, imports, assigns=None, **more):
    frame = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    given = None if assigns is None else frame(assigns, ["module", "name", "source_name"])
    out = types.propagate_types(frame(own, ["module", "name", "type"]), frame(imports, ["module", "name", "source", "source_name"]), given, **more)
    return {(r.module, r.name): (r.type, r.level) for r in out.collect()}


def test_types_over_a_chain_and_a_cycle(spark):
    own = [("base", "make()", "User"), ("base", "n", "int"), ("c2", "k", "K"), ("mid", "own", "Mine"), (None, "x", "y")]
    imports = [("mid", "make()", "base", "make()"), ("app", "build()", "mid", "make()"), ("mid", "own", "base", "n"), ("c1", "k1", "c2", "k"), ("c2", "back", "c1", "k1"), ("c1", "n", "base", "n"), ("app", "lost", "none", "x")]
    assigns = [("app", "user", "build()"), ("app", "same", "user"), ("c2", "again", "back"), ("alone", "a", "b")]
    got = typed(spark, own, imports, assigns)
    assert got[("base", "make()")] == ("User", None) and got[("mid", "own")] == ("Mine", None)
    assert got[("app", "build()")][0] == got[("app", "user")][0] == got[("app", "same")][0] == "User" and got[("app", "user")][1] > got[("mid", "make()")][1]
    assert got[("c1", "k1")][0] == got[("c2", "back")][0] == got[("c2", "again")][0] == "K" and got[("c1", "n")][0] == "int"
    assert ("app", "lost") not in got and ("alone", "a") not in got and len(got) == 12
    assert typed(spark, own, imports, least_gap=1.1) == {k: (v, None) for k, v in (((m, n), t) for m, n, t in own if m)}
    assert typed(spark, [], imports) == {}
