"""Contracts, routes and services: matching by equi joins, deduplication, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import routes


def other_party(a: str = "p", b: str = "c") -> Column:
    """Not the same repository, or the same one with two known, different services."""
    same_repo = F.col(f"{a}.repo") == F.col(f"{b}.repo")
    same_service = F.col(f"{a}.service").isNull() | F.col(f"{b}.service").isNull() | (F.col(f"{a}.service") == F.col(f"{b}.service"))
    return ~(same_repo & same_service)


def dedup_contracts(contracts: DataFrame) -> DataFrame:
    """One row for each (repo, contractId, role, filePath): the richest record, missing fields filled in, highest confidence."""
    c = contracts.withColumn("contractId", routes.contract_id(F.col("contractId")))
    rich = (
        F.when(F.col("symbolUid").isNotNull(), 3).otherwise(0) + F.when(F.col("filePath").isNotNull(), 2).otherwise(0)
        + F.when(F.col("symbolName").isNotNull(), 4).otherwise(0) + F.when(F.col("service").isNotNull(), 1).otherwise(0)
    )
    rank = F.struct((-rich).alias("r"), F.coalesce("symbolUid", F.lit("~")).alias("u"))
    filled = ["symbolUid", "symbolName", "service", "type", "meta"]
    return c.groupBy("repo", "contractId", "role", "filePath").agg(
        *[F.min_by(x, F.when(F.col(x).isNotNull(), F.struct(rank.alias("k"), F.col(x).alias("v")))).alias(x) for x in filled],
        F.max("confidence").alias("confidence"),
    )


def match_contracts(contracts: DataFrame) -> DataFrame:
    """Provider and consumer pairs: exact ids (1.0), HTTP consumers of any method, gRPC consumers of any method of a service."""
    c = contracts.withColumn("cid", routes.contract_id(F.col("contractId")))
    p, k = c.where("role = 'provider'").alias("p"), c.where("role = 'consumer'").alias("c")
    cols = [F.col(f"{s}.{x}").alias(f"{n}{x[0].upper()}{x[1:]}") for s, n in (("c", "from"), ("p", "to")) for x in ("repo", "symbolUid")]
    exact = p.join(k, F.col("p.cid") == F.col("c.cid")).where(other_party()).select(*cols, F.col("p.cid").alias("contractId"), F.lit("exact").alias("matchType"), F.lit(1.0).alias("confidence"))
    path = lambda s: F.regexp_extract(F.col(f"{s}.cid"), r"^http::[^:]+::(.*)$", 1)
    any_method = p.where("cid like 'http::%'").join(k.where("cid like 'http::*::%'"), path("p") == path("c")).where(other_party() & (F.col("p.cid") != F.col("c.cid")))
    package = lambda s: F.regexp_extract(F.col(f"{s}.cid"), r"^grpc::([^/]+)", 1)
    bare = lambda s: F.substring_index(package(s), ".", -1)
    wild = p.where("cid like 'grpc::%'").join(k.where("cid like 'grpc::%/*'"), bare("p") == bare("c")).where(
        other_party() & ((package("p") == package("c")) | (package("c") == bare("c"))) & (F.col("p.cid") != F.col("c.cid"))
    )
    low = F.least("p.confidence", "c.confidence")
    more = [df.select(*cols, F.col("p.cid").alias("contractId"), F.lit("wildcard").alias("matchType"), low.alias("confidence")) for df in (any_method, wild)]
    found = exact.unionByName(more[0]).unionByName(more[1])
    return found.groupBy(*[x for x in found.columns if x not in ("confidence", "matchType")]).agg(F.max("confidence").alias("confidence"), F.min("matchType").alias("matchType"))


def unmatched(contracts: DataFrame, links: DataFrame) -> DataFrame:
    used = links.select(F.col("toRepo").alias("repo"), "contractId").unionByName(links.select(F.col("fromRepo").alias("repo"), "contractId"))
    return contracts.withColumn("contractId", routes.contract_id(F.col("contractId"))).join(used, ["repo", "contractId"], "left_anti")


def match_routes(fetches: DataFrame, table: DataFrame) -> DataFrame:
    """(fetch_id, route_id): the first fitting route in registry order. Candidates meet on the first segment or a wildcard."""
    head = lambda c: F.coalesce(F.try_element_at(routes.segments(c), F.lit(1)), F.lit(""))
    wild = lambda c: F.when(F.startswith(c, F.lit("[")), "*").otherwise(c)
    f = fetches.withColumn("u", routes.fetch_url(F.col("url"))).where("u is not null").withColumn("h", wild(head(F.col("u"))))
    r = table.withColumn("rh", wild(head(F.col("route"))))
    plain = f.where("h != '*'").join(r, (F.col("h") == F.col("rh")))
    route_wild = f.where("h != '*'").withColumn("any", F.lit("*")).join(r, F.col("any") == F.col("rh")).drop("any")
    fetch_wild = f.where("h = '*'").join(r, F.size(routes.segments(F.col("u"))) == F.size(routes.segments(F.col("route"))))
    fits = [x.where(routes.route_fits(F.col("u"), F.col("route"))).select("fetch_id", "route_id", "seq") for x in (plain, route_wild, fetch_wild)]
    every = fits[0].unionByName(fits[1]).unionByName(fits[2])
    return every.groupBy("fetch_id").agg(F.min(F.struct("seq", "route_id")).alias("r")).select("fetch_id", "r.route_id")


def match_tails(transports: DataFrame, table: DataFrame) -> DataFrame:
    """(transport_id, route_id, tail): routes that share the longest tail with a transport's path; a transport that shares
    none gets the routes that begin with its longest possible tail (a service whose route names an operation below it)."""
    t = transports.select("transport_id", F.explode(routes.tails(F.col("path"))).alias("tail"))
    r = table.select("route_id", F.explode(routes.tails(F.col("route"))).alias("tail"))

    def longest(both: DataFrame) -> DataFrame:
        best = both.groupBy("transport_id").agg(F.max(F.length("tail")).alias("n"))
        return both.join(best, "transport_id").where(F.length("tail") == F.col("n")).select("transport_id", "route_id", "tail").distinct()

    shared = longest(t.join(r, "tail"))
    starts = table.select("route_id", F.explode(routes.path_prefixes(F.lower("route"))).alias("tail"))
    below = t.join(shared.select("transport_id").distinct(), "transport_id", "left_anti").join(starts, "tail")
    return shared.unionByName(longest(below))


def match_topics(transports: DataFrame, listeners: DataFrame) -> DataFrame:
    """(transport_id, listener_id): equal topics, else one a prefix of the other at ``.``, ``-`` or ``_``; unresolved ones are skipped."""
    t = transports.where("topic is not null and not contains(topic, '${')").select("transport_id", "topic")
    r = listeners.where("topic is not null and not contains(topic, '${')").select("listener_id", F.col("topic").alias("lt"))
    exact = t.join(r, t.topic == r.lt).select("transport_id", "listener_id")
    left = t.join(exact, "transport_id", "left_anti")
    down = left.select("transport_id", F.explode(routes.topic_prefixes(F.col("topic"))).alias("p")).join(r, F.col("p") == r.lt)
    up = r.select("listener_id", F.explode(routes.topic_prefixes(F.col("lt"))).alias("p")).join(left, F.col("p") == left.topic)
    return exact.unionByName(down.select("transport_id", "listener_id")).unionByName(up.select("transport_id", "listener_id")).distinct()


def longest_prefix(files: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(path, service): the deepest service folder at or above each file."""
    up = files.select("path", F.explode(routes.path_prefixes(F.col("path"))).alias("root"))
    return up.join(boundaries, "root").groupBy("path").agg(F.max_by("service", F.struct(F.length("root"), "service")).alias("service"))


def api_risk(consumers: Column, mismatched: Column) -> Column:
    level = F.when(consumers >= 10, 2).when(consumers >= 4, 1).otherwise(0) + F.when(mismatched, 1).otherwise(0)
    return F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.least(level, F.lit(2)) + 1)


def change_risk(n: Column) -> Column:
    return F.when(n == 0, "none").when(n <= 5, "low").when(n <= 15, "medium").otherwise("high")


def cross_risk(local: Column, hits: Column, best: Column) -> Column:
    return (
        F.when((local == "CRITICAL") | (hits >= 3), "CRITICAL").when(best >= 0.85, "HIGH")
        .when((hits > 0) & local.isin("LOW", "UNKNOWN"), "MEDIUM").otherwise(local)
    )


def key_drift(accessed: Column, response: Column, errors: Column) -> Column:
    """(missing, error_path): keys that consumers read but no response has, and those only error responses have."""
    return F.struct(
        F.sort_array(F.array_except(accessed, F.array_union(response, errors))).alias("missing"),
        F.sort_array(F.array_except(F.array_intersect(accessed, errors), response)).alias("error_path"),
    )
