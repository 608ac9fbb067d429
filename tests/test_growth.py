"""Steps whose rows must grow with the input, not with pairs of it."""

import random

from pyspark.sql import functions as F

from weftgraph import storage
from weftgraph.operators import components, hierarchy, lookup, pattern, traverse, types
from weftgraph.sources import files, graph_view


def most_rows(df):
    """The result's rows, and the most rows that a node of its executed plan has put out."""
    rows, most = df.collect(), 0
    stack = [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            stack.append(node.plan())
        children = node.children()
        stack.extend(children.apply(k) for k in range(children.size()))
        n = node.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
    return rows, most


def test_innermost_against_all_pairs(spark):
    r = random.Random(5)
    scopes = [(r.choice("ab"), a, a + r.choice([0, 1, 5, 63, 64, 300]), k) for k in range(400) for a in [r.randint(-200, 200)]] + [("a", 5, 4, 900), (None, -500, 500, 901)]
    points = [(k, r.choice(["a", "b", None]), r.randint(-250, 550)) for k in range(400)]
    want = {}
    for p, file, x in points:
        held = [(b - a, -a, k) for f, a, b, k in scopes if f == file is not None and a <= x <= b]
        if held:
            want[p] = min(held)[2]
    got = hierarchy.innermost(spark.createDataFrame(points, "point_id long, file string, line long"), spark.createDataFrame(scopes, "file string, start_line long, end_line long, scope_id long"))
    assert {x.point_id: x.scope_id for x in got.collect()} == want


def test_innermost_makes_no_pairs_of_scopes_and_points(spark):
    n = 600
    s = spark.range(n).select(F.lit("f").alias("file"), (F.col("id") % 7).alias("start_line"), F.col("id").alias("scope_id")).withColumn("end_line", F.col("start_line") + 40)
    p = spark.range(n).select(F.col("id").alias("point_id"), F.lit("f").alias("file"), (F.col("id") % 20 + 10).alias("line"))
    rows, most = most_rows(hierarchy.innermost(p, s))
    assert len(rows) == n and {x.scope_id for x in rows} == {6} and most <= 20 * n


def test_tier_counts_make_no_pairs(spark):
    n = 600
    c = spark.range(n).select(F.col("id").alias("request_id"), F.lit(1).alias("region"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("cn"))
    u = spark.range(n).select(F.col("id").alias("s"), F.lit(1).alias("region"), (F.col("id") % 2).alias("sn"))
    tiers = ["region"], [F.col("cn") == F.col("sn"), F.lit(True)], [0.95, 0.9]
    single = pattern.resolve_tiers(c, u, *tiers).groupBy("request_id", "tier", "confidence").agg(F.count("*").alias("n"), F.min("s").alias("first"))
    want = {(x.request_id, x.tier, x.n, x.first, x.confidence) for x in single.collect()}
    rows, most = most_rows(pattern.tier_counts(c, u, *tiers, "s"))
    assert {tuple(x) for x in rows} == want and most <= n


def test_references_list_candidates_once_for_a_question(spark):
    n = 300
    name = lambda k: F.concat(F.lit(k), (F.col("id") % 5).cast("string"))
    sites = spark.range(3 * n).select(F.col("id").alias("site"), name("s").alias("scope"), F.lit("k").alias("name"), F.when(F.col("id") % 3 == 0, "me").alias("receiver"), F.when(F.col("id") % 4 > 0, F.col("id") % 2).cast("int").alias("arity"))
    sites = sites.withColumn("name", F.when(F.col("site") % 3 == 1, "far").otherwise(F.col("name")))
    tree = spark.createDataFrame([(f"s{i}", "top") for i in range(5)] + [("top", None)], "scope string, parent string")
    d = spark.range(n).select(F.concat(F.lit("d"), "id").alias("def"), F.col("id"))
    bound = d.select(F.lit("top").alias("scope"), F.lit("k").alias("name"), "def", F.lit("local").alias("origin"))
    types = spark.createDataFrame([("top", "me", "T")], "scope string, name string, owner string")
    members = d.select(F.lit("T").alias("owner"), F.lit("k").alias("name"), "def")
    order = spark.createDataFrame([("T", "T", 0)], "owner string, ancestor string, depth int")
    defs = d.select("def", F.lit("a.far").alias("qualified"), (F.col("id") % 3).cast("int").alias("min_arity"), (F.col("id") % 3).cast("int").alias("max_arity"), F.lit(None).cast("string").alias("returns"))
    frames = [sites, tree, bound, types, members, order, defs]
    whole = lookup.resolve_references(*frames).collect()
    assert len(whole) > 100 * n
    rows, most = most_rows(lookup.best_references(*frames))
    assert {tuple(r) for r in rows} == {(r.site, r["def"], r.stage, r.confidence) for r in whole if r.rank == 1} and len(rows) == 3 * n
    assert most <= 10 * n
    sums = {}
    for r in whole:
        sums.setdefault(r.stage, []).append((r.site, r.confidence))
    rows, most = most_rows(lookup.reference_summary(*frames))
    assert {(r.stage, r.sites, r.candidates, round(r["mean"], 6)) for r in rows} == {(k, len({s for s, _ in v}), len(v), round(sum(c for _, c in v) / len(v), 6)) for k, v in sums.items()}
    assert len(rows) == 3 and most <= 10 * n


def test_rounds_send_no_join_side_through_the_driver(spark, monkeypatch):
    plans = []

    def written(module, write):
        def spy(df, *rest):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, *rest)

        monkeypatch.setattr(module, "write_table", spy)

    for module in (components, traverse, types):
        written(module, module.write_table)
    e = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")]
    own = spark.createDataFrame([("d", "v", "T")], "module string, name string, type string")
    imports = spark.createDataFrame([(a, "v", b, "v") for a, b in e], "module string, name string, source string, source_name string")
    got = types.propagate_types(own, imports)
    assert {(r["module"], r["type"], r["level"]) for r in got.collect()} == {("d", "T", None), ("c", "T", 1), ("b", "T", 2), ("a", "T", 2)}
    assert len(plans) > 20 and not [x for x in plans if "Broadcast" in x]


def test_contained_pairs_are_grouped_in_tasks_of_bounded_size(spark, sf_dir, monkeypatch):
    """no task groups more than about TASK_ROWS line items, neither before nor after their shuffle; the edges stay the same."""
    whole = sorted(map(tuple, graph_view.graph_edges(spark, sf_dir, ["CONTAINS"]).collect()))
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    edges = graph_view.graph_edges(spark, sf_dir, ["CONTAINS"])
    assert sorted(map(tuple, edges.collect())) == whole
    n = -(-graph_view.table(spark, sf_dir, "lineitem").count() // 100)
    assert edges.rdd.getNumPartitions() == n > spark.sparkContext.defaultParallelism
    before_shuffle = edges._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]
    assert "Aggregate" not in before_shuffle


def test_a_graph_is_written_from_one_pass_over_its_edges(spark, tmp_path):
    """what writes the edges counts them; they are not made a second time."""
    made = spark.sparkContext.accumulator(0)

    def noted(parts):
        for part in parts:
            made.add(len(part))
            yield part

    nodes = spark.createDataFrame([(f"n{k}", "AB"[k % 2]) for k in range(10)], "id string, label string")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 3}") for k in range(10)], "src string, dst string").mapInPandas(noted, "src string, dst string")
    assert files.write_graph(nodes, edges, f"{tmp_path}/g") == {"nodes": 10, "edges": 7, "skipped": 3}
    assert made.value == 10
    assert files.read_graph(spark, f"{tmp_path}/g")[1].count() == 7
    assert files.write_graph(nodes.where("id is null"), edges, f"{tmp_path}/none") == {"nodes": 0, "edges": 0, "skipped": 10}


def test_supplied_pairs_are_told_apart_in_tasks_of_bounded_size(spark, sf_dir, monkeypatch):
    """the distinct pairs of SUPPLIES, as those of CONTAINS."""
    whole = sorted(map(tuple, graph_view.graph_edges(spark, sf_dir, ["SUPPLIES"]).collect()))
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    edges = graph_view.graph_edges(spark, sf_dir, ["SUPPLIES"])
    assert sorted(map(tuple, edges.collect())) == whole
    assert edges.rdd.getNumPartitions() == -(-graph_view.table(spark, sf_dir, "lineitem").count() // 100)
