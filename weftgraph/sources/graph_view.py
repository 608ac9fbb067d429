"""The property graph over the star-schema tables: nodes and edges as DataFrames that scan only what a query needs."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.plans.schema import edge_id, node_id
from weftgraph.storage import in_parts


class PropertyGraph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, label: str, key: str, name: str, path, value) -> DataFrame:
    return df.select(
        node_id(label, F.col(key)).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), path.alias("filePath"), value.cast("double").alias("value")
    )


def graph_nodes(spark: SparkSession, sf_dir: str, labels: list[str] | None = None) -> DataFrame:
    """(id, label, name, filePath, value) of the labels asked for (all but documents and pages by default)."""
    none, zero = F.lit(""), F.lit(0.0)
    of = {
        "Region": lambda: _nodes(table(spark, sf_dir, "region"), "Region", "r_regionkey", "r_name", none, zero),
        "Nation": lambda: _nodes(table(spark, sf_dir, "nation"), "Nation", "n_nationkey", "n_name", none, F.col("n_regionkey")),
        "Customer": lambda: _nodes(table(spark, sf_dir, "customer"), "Customer", "c_custkey", "c_name", F.col("c_mktsegment"), F.col("c_acctbal")),
        "Supplier": lambda: _nodes(table(spark, sf_dir, "supplier"), "Supplier", "s_suppkey", "s_name", none, F.col("s_acctbal")),
        "Part": lambda: _nodes(table(spark, sf_dir, "part"), "Part", "p_partkey", "p_name", F.col("p_type"), F.col("p_retailprice")),
        "Order": lambda: _nodes(table(spark, sf_dir, "orders"), "Order", "o_orderkey", "o_orderpriority", F.col("o_orderstatus"), F.col("o_totalprice")),
        "EventType": lambda: _nodes(table(spark, sf_dir, "events").select("event_type").distinct(), "EventType", "event_type", "event_type", none, zero),
        "Page": lambda: _nodes(table(spark, sf_dir, "pages"), "Page", "page_id", "url", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), zero),
        "Document": lambda: _nodes(table(spark, sf_dir, "documents"), "Document", "doc_id", "source", F.col("source"), F.col("n_chars")),
    }
    wanted = labels or ["Region", "Nation", "Customer", "Supplier", "Part", "Order", "EventType"]
    return reduce(DataFrame.unionByName, [of[x]() for x in wanted])


def _edges(df: DataFrame, kind: str, src, dst, confidence=None, step=None) -> DataFrame:
    pair = df.select(
        src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"),
        (F.lit(1.0) if confidence is None else confidence).alias("confidence"), (F.lit(None) if step is None else step).cast("int").alias("step"),
    )
    return pair.select(edge_id(F.col("type"), F.col("src"), F.col("dst")).alias("id"), "*")


def next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_type, next_type) of consecutive events of a user, by time and id."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.lead("event_type").over(w).alias("next_type"))
    return e.where("next_type is not null")


def graph_edges(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    """(id, src, dst, type, confidence, step) of the types asked for; one edge for each (type, src, dst)."""

    def contains() -> DataFrame:
        g = in_parts(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.max("l_discount").alias("d"), F.min("l_linenumber").alias("s"))
        return _edges(g, "CONTAINS", node_id("Order", F.col("l_orderkey")), node_id("Part", F.col("l_partkey")), F.round(1 - F.col("d"), 4), F.col("s"))

    def supplies() -> DataFrame:
        g = in_parts(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey").select("l_suppkey", "l_partkey").distinct()
        return _edges(g, "SUPPLIES", node_id("Supplier", F.col("l_suppkey")), node_id("Part", F.col("l_partkey")), F.lit(0.9))

    def in_nation() -> DataFrame:
        c = _edges(table(spark, sf_dir, "customer"), "IN_NATION", node_id("Customer", F.col("c_custkey")), node_id("Nation", F.col("c_nationkey")))
        return c.unionByName(_edges(table(spark, sf_dir, "supplier"), "IN_NATION", node_id("Supplier", F.col("s_suppkey")), node_id("Nation", F.col("s_nationkey"))))

    def did() -> DataFrame:
        g = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
        return _edges(g, "DID", node_id("Customer", F.col("user_id")), node_id("EventType", F.col("event_type")), F.lit(0.8))

    def follows() -> DataFrame:
        g = next_events(spark, sf_dir).select("event_type", "next_type").distinct()
        return _edges(g, "NEXT_EVENT", node_id("EventType", F.col("event_type")), node_id("EventType", F.col("next_type")), F.lit(0.7))

    of = {
        "PLACED": lambda: _edges(table(spark, sf_dir, "orders"), "PLACED", node_id("Customer", F.col("o_custkey")), node_id("Order", F.col("o_orderkey"))),
        "CONTAINS": contains,
        "SUPPLIES": supplies,
        "IN_NATION": in_nation,
        "IN_REGION": lambda: _edges(table(spark, sf_dir, "nation"), "IN_REGION", node_id("Nation", F.col("n_nationkey")), node_id("Region", F.col("n_regionkey"))),
        "DID": did,
        "NEXT_EVENT": follows,
    }
    return reduce(DataFrame.unionByName, [of[t]() for t in (types or of)])


def load_graph(spark: SparkSession, sf_dir: str, labels: list[str] | None = None, types: list[str] | None = None) -> PropertyGraph:
    return PropertyGraph(graph_nodes(spark, sf_dir, labels), graph_edges(spark, sf_dir, types))
