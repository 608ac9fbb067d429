"""Scope sweep, copybook expansion and staged lookup against plain versions."""

import random

from weftgraph.operators import inclusion, lookup, scopes

SCOPE = "file string, scope_id long, start_line int, start_col int, end_line int, end_col int"


def nested(rng, file, first, lo, hi, depth, out):
    """Random scopes inside (lo, hi): (file, id, start, end)."""
    at = lo
    while at + 3 < hi and depth < 6:
        a = rng.randrange(at + 1, hi)
        b = rng.randrange(a, hi)
        out.append((file, first[0], divmod(a, 10), divmod(b, 10)))
        first[0] += 1
        nested(rng, file, first, a, b, depth + 1, out)
        at = b + 1


def plain_parents(rows):
    out = {}
    for f, i, a, b in rows:
        around = [(s, (-e[0], -e[1]), k) for g, k, s, e in rows if g == f and s <= a and e >= b and (s, (-e[0], -e[1]), k) < (a, (-b[0], -b[1]), i)]
        out[i] = (max(around)[2] if around else None, len(around))
    return out


def test_scope_tree(spark):
    rng, rows, first = random.Random(3), [], [0]
    for f in ("a.py", "b.py", None):
        nested(rng, f, first, 0, 400, 0, rows)
    rows += [("x.py", 9000, (1, 0), (9, 0)), ("x.py", 9001, (2, 0), (12, 0)), ("x.py", 9002, (3, 0), (4, 0)), ("x.py", 9003, (3, 0), (4, 0)), ("x.py", 9004, (10, 0), (11, 0))]
    flat = [(f, i, *a, *b) for f, i, a, b in rows]
    rng.shuffle(flat)
    df = spark.createDataFrame([*flat, ("bad", 1, 5, 0, 4, 0), ("bad", None, 1, 0, 2, 0)], SCOPE)
    got = scopes.scope_tree(df).collect()
    assert {r.scope_id: (r.parent, r.depth) for r in got} == plain_parents(rows)
    # 9001 crosses 9000; the others lie in open scopes only
    assert {r.scope_id: r.crosses for r in got if r.crosses} == {9001: 1}
    points = [(rng.choice(["a.py", "b.py", None, "no.py"]), k, rng.randrange(42), rng.randrange(10)) for k in range(300)]
    want = {k: max([(a, (-b[0], -b[1]), i) for f, i, a, b in rows if f == g and a <= (line, col) <= b], default=(None, None, None))[2] for g, k, line, col in points}
    at = scopes.innermost_at(spark.createDataFrame(points, "file string, point_id long, line int, col int"), df)
    assert {r.point_id: r.scope_id for r in at.collect()} == want


def test_scope_faults(spark):
    rows = [("a", 1, "Module", 1, 0, 50, 0), ("a", 2, "Function", 2, 0, 9, 0), ("a", 3, "Function", 9, 0, 12, 0), ("a", 4, "Block", 2, 0, 9, 0), ("a", 4, "Block", 20, 0, 21, 0),
            ("b", 5, "Function", 1, 0, 2, 0), ("c", 6, "Module", 1, 0, 9, 0), ("c", 7, "Class", 2, 0, 8, 0)]
    df = spark.createDataFrame(rows, "file string, scope_id long, kind string, start_line int, start_col int, end_line int, end_col int")
    got = {(r.file, r.fault): r.n for r in scopes.scope_faults(df).collect()}
    assert got[("a", "duplicate id")] == 1 and got[("b", "no parent")] == 1 and ("a", "parent not larger") in got and got[("a", "siblings overlap")] >= 1
    assert not any(f == "c" for f, _ in got)


def expanded(spark, programs, books, depth=10):
    done = inclusion.expand_copies(spark.createDataFrame(programs, "program string, line int, text string"), spark.createDataFrame(books, "name string, line int, text string"), depth)
    return [(r.program, r.text, r.source, r.line, r.note) for r in done.orderBy("program", "place").collect()]


def test_copies_nest_and_keep_their_lines(spark):
    programs = [("p", 1, "START"), ("p", 2, "  copy Book replacing ==X== by ==PX== ==Y== by ==Z==."), ("p", 3, "END"), ("q", 1, "COPY 'NONE'."), ("q", 2, "COPYING BOOK."), ("q", None, "x")]
    books = [("BOOK", 1, "X1"), ("book", 2, "COPY INNER REPLACING ==Q== BY ==X==."), ("BOOK", 3, "Y3"), ("INNER", 1, "Q and X"), ("INNER", 2, "COPY BOOK."), (None, 1, "lost")]
    assert expanded(spark, programs, books) == [
        ("p", "START", "p", 1, None), ("p", "PX1", "BOOK", 1, None), ("p", "PX and PX", "INNER", 1, None), ("p", "COPY BOOK.", "INNER", 2, "circular"), ("p", "Z3", "BOOK", 3, None),
        ("p", "END", "p", 3, None), ("q", "COPY 'NONE'.", "q", 1, "missing"), ("q", "COPYING BOOK.", "q", 2, None),
    ]
    chain = [(f"B{i}", 1, f"COPY B{i + 1}.") for i in range(12)] + [("B12", 1, "deep")]
    assert expanded(spark, [("p", 1, "COPY B0.")], chain) == [("p", "COPY B10.", "B9", 1, "too deep")]
    assert expanded(spark, [("p", 1, "COPY B5.")], chain) == [("p", "deep", "B12", 1, None)]
    cycles = inclusion.copy_cycles(spark.createDataFrame([*books, ("SELF", 1, "COPY SELF.")], "name string, line int, text string"))
    assert {(r["name"], r.component) for r in cycles.collect()} == {("BOOK", "BOOK"), ("INNER", "BOOK"), ("SELF", "SELF")}
    assert expanded(spark, [("p", 1, "COPY B0.")], []) == [("p", "COPY B0.", "p", 1, "missing")]


def frames(spark, sites):
    make = spark.createDataFrame
    tree = make([("mod", None), ("fun", "mod"), ("block", "fun"), ("odd1", "odd2"), ("odd2", "odd1")], "scope string, parent string")
    bound = make([("mod", "f", "m.f", "local"), ("fun", "f", "x.f", "import"), ("fun", "g", "x.g1", "wildcard"), ("fun", "g", "x.g2", "wildcard"), ("mod", "h", "m.h", "namespace")], "scope string, name string, def string, origin string")
    types = make([("fun", "a", "A"), ("mod", "a", "Hidden")], "scope string, name string, owner string")
    members = make([("A", "b", "A.b"), ("Base", "run", "Base.run"), ("B", "run", "B.run"), ("B", "over", "B.over1"), ("B", "over", "B.over2")], "owner string, name string, def string")
    order = make([("A", "A", 0), ("A", "Base", 1), ("B", "B", 0), ("B", "Base", 1), ("Hidden", "Hidden", 0)], "owner string, ancestor string, depth int")
    defs = [("A.b", "A.b", None, None, "B"), ("Base.run", "Base.run", 0, 0, None), ("B.run", "B.run", 1, 2, None), ("B.over1", "B.over", 1, 1, None), ("B.over2", "B.over", 2, None, None),
            ("m.f", "m.f", None, None, None), ("x.g1", "x.g1", 0, 0, None), ("x.g2", "x.g2", 3, 3, None), ("far.k", "far.k", None, None, None)]
    return make(sites, "site long, scope string, name string, receiver string, arity int"), tree, bound, types, members, order, make(defs, "def string, qualified string, min_arity int, max_arity int, returns string")


def test_lookup_stages(spark):
    sites = [(1, "block", "f", None, None), (2, "block", "g", None, 0), (3, "block", "g", None, 9), (4, "block", "run", "a", 0), (5, "block", "run", "a.b", 2), (6, "block", "over", "a.b", 2), (7, "block", "k", "far", None),
             (8, "mod", "k", None, None), (9, "odd1", "nothing", None, None), (10, "block", "h", None, None), (11, "block", "run", "a.b.c", None), (None, "mod", "f", None, None)]
    got = lookup.resolve_references(*frames(spark, sites)).orderBy("site", "rank").collect()
    rows = {}
    for r in got:
        rows.setdefault(r.site, []).append((r["def"], r.stage, r.confidence))
    assert rows[1] == [("x.f", "lexical", 0.43)]  # the import of the function hides the module's own
    assert rows[2] == [("x.g1", "lexical", 0.38)]  # a compatible overload drops the other
    assert rows[3] == [("x.g1", "lexical", 0.13), ("x.g2", "lexical", 0.13)]  # none fits: all stay, with a penalty
    assert rows[4] == [("Base.run", "receiver", 0.52)]  # by the order of A, not of the hidden type
    assert rows[5] == [("B.run", "receiver", 0.8)]  # a.b has the type that A.b returns
    assert rows[6] == [("B.over2", "receiver", 0.8)]
    assert rows[7] == [("far.k", "global", 0.35)] and rows[8] == [("far.k", "global", 0.1)]
    assert rows[10] == [("m.h", "lexical", 0.36)]
    assert 9 not in rows and 11 not in rows and None not in rows


def test_lookup_of_nothing(spark):
    assert lookup.resolve_references(*frames(spark, [])).count() == 0
