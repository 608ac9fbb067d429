"""Registered queries of symbol views, source scans, service lists and stored graphs, each through its library function."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import shapes, text
from weftgraph.operators import context, hierarchy, search
from weftgraph.plans.queries import E, G, query
from weftgraph.sources import files
from weftgraph.sources.graph_view import graph_edges, graph_nodes, table
from weftgraph.storage import scratch_dir

#: How the relation types of the tables stand for those of a code graph.
_AS_CODE = {"PLACED": "CALLS", "IN_NATION": "IMPORTS", "IN_REGION": "EXTENDS", "SUPPLIES": "ACCESSES"}
_KIND = "case type " + " ".join(f"when '{a}' then '{b}'" for a, b in _AS_CODE.items()) + " end"


def _code_edges(s, d):
    kind = F.create_map(*[F.lit(x) for pair in _AS_CODE.items() for x in pair])
    return graph_edges(s, d, list(_AS_CODE)).withColumn("type", kind[F.col("type")])


@query("symbol_context", G + f""", e as (select src, dst, {_KIND} as type from edges where type in ('PLACED', 'IN_NATION', 'IN_REGION', 'SUPPLIES')),
 r as (select dst as symbol, 'in' as direction, type, src as other from e where dst in ('Nation:3', 'Region:1', 'Customer:7') union select src, 'out', type, dst from e where src in ('Nation:3', 'Region:1', 'Customer:7')),
 k as (select *, row_number() over (partition by symbol, direction order by type, other) as k from r)
 select symbol, direction, type, other, name, fp as "filePath", label from k join nodes on id = other where k <= 30""")
def symbol_context(s, d):
    me = s.createDataFrame([("Nation:3",), ("Region:1",), ("Customer:7",)], "id string")
    return context.context(me, graph_nodes(s, d), _code_edges(s, d))


@query("implementations", E + """, own as (select dst as method from edges where src = 'Nation:3' and type = 'IN_REGION')
 select 'Nation:3' as interface, 'class' as relation, src as id from edges where type = 'IN_NATION' and dst = 'Nation:3'
 union all select 'Nation:3', 'method', src from edges join own on dst = method where type = 'IN_REGION'""")
def implementations(s, d):
    e = graph_edges(s, d, ["IN_NATION", "IN_REGION"]).select("src", "dst", F.when(F.col("type") == "IN_NATION", "IMPLEMENTS").otherwise("METHOD_IMPLEMENTS").alias("type"))
    has = graph_edges(s, d, ["IN_REGION"]).select("src", "dst", F.lit("HAS_METHOD").alias("type"))
    return context.implementations_of(s.createDataFrame([("Nation:3",)], "id string"), graph_nodes(s, d), e.unionByName(has)).select("interface", "relation", "id")


@query("enrich_hits", E + """, h as (select 'Customer:' || c_custkey as id from customer where c_custkey % 100 = 0), r as (select src as id, type, dst as other, 'out' as direction from edges union select dst, type, src, 'in' from edges),
 k as (select r.*, row_number() over (partition by id, direction order by type, other) as k from r join h using (id)) select id, direction, type, other from k where k <= 5""")
def enrich_hits(s, d):
    hits = table(s, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return context.enrich_hits(hits, graph_edges(s, d))


@query("service_scope", """select 'c' || c_custkey as id from customer where c_nationkey = 3
 union select 't' || event_type from events join customer on user_id = c_custkey where c_nationkey = 3
 union select 'x' || o_orderpriority from orders join customer on o_custkey = c_custkey where c_nationkey = 3 union select 'n3:a' union select 'n3'""")
def service_scope(s, d):
    none = F.lit(None).cast("string")
    cust, ev = table(s, d, "customer"), table(s, d, "events").select("user_id", "event_type").distinct()
    orders = table(s, d, "orders").select("o_custkey", "o_orderpriority").distinct()
    n = cust.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Class").alias("label"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("repoId"))
    n = n.unionByName(ev.select(F.concat(F.lit("t"), "event_type").alias("id"), F.lit("Tool").alias("label"), none.alias("repoId")).distinct())
    n = n.unionByName(orders.select(F.concat(F.lit("x"), "o_orderpriority").alias("id"), F.lit("Transport").alias("label"), none.alias("repoId")).distinct())
    n = n.unionByName(s.createDataFrame([("n3:a", "BusinessGroup", "z"), ("n4:a", "BusinessGroup", "z"), ("n3", "ServiceNode", "z")], "id string, label string, repoId string"))
    e = ev.select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("t"), "event_type").alias("dst"), F.lit("HANDLES_TOOL").alias("type"))
    e = e.unionByName(orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("x"), "o_orderpriority").alias("dst"), F.lit("TRANSPORTS_TO").alias("type")))
    return context.service_scope(n, e, "n3").select("id")


def _sinks(s, d):
    c = F.round(F.col("value") / 500, 6)
    return table(s, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("sinkType"), F.lit("out").alias("sinkCategory"), c.alias("confidence"), F.when(c < 0.02, "").otherwise("literal").alias("resolvedVia"),
        F.when(F.col("value") > 100, "resolved").when(F.col("value") > 50, "open").alias("resolutionStatus"), F.when(F.col("value") > 20, F.col("event_type")).alias("resolutionReason"), F.lit("v").alias("value"),
    )


@query("unresolved_sinks", "select event_id as id, round(value / 500, 6) as confidence from events where event_type = 'view' and round(value / 500, 6) < 0.5 order by confidence, id limit 50")
def unresolved_sinks(s, d):
    return context.list_sinks(_sinks(s, d), "unresolved", "view").select("id", "confidence")


@query("unresolved_reasons", "select case when value > 20 then event_type else 'insufficient_context' end as value, count(*) as n from events where not value > 100 group by 1")
def unresolved_reasons(s, d):
    return context.unresolved_by(_sinks(s, d), "resolutionReason", "insufficient_context")


@query("seed_counts", "select event_type as kind, count(distinct user_id) as n from events group by 1")
def seed_counts(s, d):
    return context.seed_counts(table(s, d, "events").select(F.col("user_id").alias("id"), "event_type"), F.col("event_type"))


@query("manual_overlay", """select event_id as id, case when event_id % 7 = 0 then 'hand' else 'v' end as value, case when event_id % 7 = 0 then 1.0 else round(value / 500, 6) end as confidence,
 case when event_id % 7 = 0 then 'manual' when round(value / 500, 6) < 0.02 then '' else 'literal' end as "resolvedVia" from events""")
def manual_overlay(s, d):
    sinks = _sinks(s, d)
    manual = sinks.where("id % 7 = 0").select("id", F.lit("hand").alias("value"))
    return context.overlay_manual(sinks, manual).select("id", "value", "confidence", "resolvedVia")


@query("library_dependencies", """select 's' || p_size as src, 'lib:' || p_brand as dst, max(nullif(case when p_partkey % 3 = 0 then '' else p_type end, '')) as version from part group by all""")
def library_dependencies(s, d):
    p = table(s, d, "part")
    version = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("<version> "), "p_type", F.lit("</version>")))
    xml = F.concat(F.lit("<dependencies>\n<dependency>\n<artifactId>"), "p_brand", F.lit("</artifactId>"), version, F.lit("</dependency><dependency><artifactId>other</artifactId></dependency>"))
    poms = p.select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("service"), xml.alias("text"))
    known = p.select(F.col("p_brand").alias("artifactId"), F.concat(F.lit("lib:"), "p_brand").alias("id")).distinct()
    return context.dependencies(poms, known)


@query("capped_orders", "select o_orderkey, (select count(*) from orders) > 100 as truncated from orders order by o_totalprice desc, o_orderkey limit 100")
def capped_orders(s, d):
    return context.capped(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100).select("o_orderkey", "truncated")


@query("middleware_matches", r"""with p as (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages)
 select page_id, path = '/en' or starts_with(path, '/en/') as under, regexp_full_match(path, '/(?:de|fr)/.*') as either, path = '/' as same from p""")
def middleware_matches(s, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    m = {"under": "/en/:path*", "either": "/(?:de|fr)/.*", "same": "/"}
    return table(s, d, "pages").select("page_id", *[shapes.matches_route(F.lit(v), path).alias(k) for k, v in m.items()])


@query("embedding_texts", """select p_partkey, md5('Class: ' || p_name || chr(10) || 'Repo: ' || p_brand || chr(10) || 'Path: ' || p_type || chr(10) || 'Export: true' || chr(10) || chr(10) || 'a' || chr(10) || chr(10) || 'b') as digest from part""")
def embedding_texts(s, d):
    node = F.struct(F.lit("Class").alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("repoId"), F.col("p_type").alias("filePath"), F.lit(True).alias("isExported"), F.lit(None).cast("string").alias("description"))
    t = table(s, d, "part").select("p_partkey", node.alias("node"))
    return t.select("p_partkey", F.md5(shapes.embedding_text(F.col("node"), F.lit("a  \r\n\r\n\r\n\r\nb\n"))).alias("digest"))


@query("text_functions", r"""select p_partkey, substr(lower(regexp_replace(p_name, '[^a-zA-Z0-9]+', '_', 'g')), 1, 20) as id, 'get-part-' || p_size as kebab, substr(repeat('ab ', 70), 1, 149) as brief, p_partkey % 2 = 0 as binary,
 upper(substr(p_type, 1, 1)) || substr(p_type, 2) as capital from part""")
def text_functions(s, d):
    p = table(s, d, "part")
    odd = F.when(F.col("p_partkey") % 2 == 0, F.lit("\x01\x02ab")).otherwise("ab")
    return p.select(
        "p_partkey", text.sanitize_id(F.col("p_name")).alias("id"), text.camel_to_kebab(F.concat(F.lit("getPart-"), F.col("p_size").cast("string"))).alias("kebab"),
        text.short_description(F.repeat(F.lit("ab "), F.lit(70))).alias("brief"), text.looks_binary(odd).alias("binary"), text.capitalize(F.col("p_type")).alias("capital"),
    )


@query("stored_graph", G + """, l as (select type, a.label as src_label, b.label as dst_label from edges join nodes a on a.id = src join nodes b on b.id = dst where a.label <> 'Order' and b.label <> 'Order')
 select src_label, dst_label, count(*) as n from l group by all""")
def stored_graph(s, d):
    nodes = graph_nodes(s, d, ["Region", "Nation", "Customer", "Supplier", "Part", "EventType"])
    path = f"{scratch_dir(s)}/graph-{abs(hash(d))}"
    files.write_graph(nodes, graph_edges(s, d), path)
    return files.read_graph(s, path)[1].groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))


@query("upserted_parts", "select p_brand, sum(case when p_size > 40 then 1 else p_size end)::bigint as total, count(*) as n from part where p_type <> 'PROMO' or p_size > 40 group by p_brand")
def upserted_parts(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_type").alias("filePath"), F.col("p_size").cast("long").alias("size"))
    none = s.createDataFrame([], "src long, dst long")
    kept, _ = files.delete_file(p, none, "PROMO")
    return files.upsert(kept, p.where("size > 40").withColumn("size", F.lit(1).cast("long"))).groupBy("p_brand").agg(F.sum("size").alias("total"), F.count("*").alias("n"))


@query("bm25_two_fields", """with one as (select doc_id as id, 'text' as f, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as t from documents union all
 select doc_id, 'lang', list_filter(regexp_split_to_array(lower(lang), '[^a-z0-9]+'), lambda x: x <> '') from documents),
 n as (select id, f, len(t) as len, len(list_filter(t, lambda x: x = 'de')) as a, len(list_filter(t, lambda x: x = 'the')) as b from one),
 st as (select f, count(*) as n, avg(len) as avg, sum((a > 0)::int) as da, sum((b > 0)::int) as db from n group by f),
 r as (select id, round(ln(1 + (st.n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / avg)) + ln(1 + (st.n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / avg)), 6) as s from n join st using (f) where a > 0 or b > 0)
 select id, round(sum(s), 6) as score from r group by id""")
def bm25_two_fields(s, d):
    return search.bm25_fields(table(s, d, "documents"), "de the", ["text", "lang"], "doc_id", stemmed=False)


@query("innermost_binned", """with s as (select p_partkey as id, p_brand as f, floor(p_retailprice)::bigint as a, floor(p_retailprice)::bigint + p_size as b from part), p as (select p_partkey as id, p_brand as f, floor(p_retailprice)::bigint + 3 as x from part)
 select p.id as point_id, arg_min(s.id, (b - a, -a, s.id)) as scope_id from p join s on p.f = s.f and x between a and b group by p.id""")
def innermost_binned(s, d):
    p = table(s, d, "part").withColumn("at", F.floor("p_retailprice"))
    scopes = p.select(F.col("p_partkey").alias("scope_id"), F.col("p_brand").alias("file"), F.col("at").alias("start_line"), (F.col("at") + F.col("p_size")).alias("end_line"))
    return hierarchy.innermost(p.select(F.col("p_partkey").alias("point_id"), F.col("p_brand").alias("file"), (F.col("at") + 3).alias("line")), scopes)
