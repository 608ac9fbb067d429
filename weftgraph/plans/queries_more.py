"""More registered queries: composed tools (impact, context, search, contracts, edits) and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.functions import routes, text
from weftgraph.operators import contracts, hierarchy, pattern, search, traverse
from weftgraph.plans.queries import _BM, _WORDS, E, query
from weftgraph.sources.graph_view import graph_edges, table


@query("impact_modules", """with hit as (select distinct o_orderkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey where o_custkey in (7, 10)),
 m as (select p_brand, count(distinct l_partkey) as hits, count(distinct o_orderkey) as orders from hit join part on p_partkey = l_partkey group by p_brand)
 select p_brand, hits, orders, case when hits >= 2 then 'direct' else 'indirect' end as reach from m""")
def impact_modules(s, d):
    seeds = s.createDataFrame([("Customer:7",), ("Customer:10",)], "id string")
    e = graph_edges(s, d, ["PLACED", "CONTAINS"])
    orders = pattern.expand(seeds, e, "out", ["PLACED"]).select(F.col("other").alias("id")).distinct()
    parts = pattern.expand(orders, e, "out", ["CONTAINS"]).select("node", F.substring_index("other", ":", -1).cast("long").alias("p_partkey"))
    g = parts.join(table(s, d, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.countDistinct("p_partkey").alias("hits"), F.countDistinct("node").alias("orders"))
    return g.withColumn("reach", F.when(F.col("hits") >= 2, "direct").otherwise("indirect"))


@query("impact_summary", """with p as (select distinct o_orderkey from orders where o_custkey = 7), q as (select count(*) as direct from p),
 t as (select count(distinct l_partkey) as parts, count(distinct p_brand) as modules from lineitem join p on l_orderkey = o_orderkey join part on p_partkey = l_partkey)
 select direct, direct + parts as total, modules, case when direct >= 30 or modules >= 5 or direct + parts >= 200 then 'CRITICAL' when direct >= 15 or modules >= 3 or direct + parts >= 100 then 'HIGH'
 when direct >= 5 or direct + parts >= 30 then 'MEDIUM' else 'LOW' end as risk from q, t""")
def impact_summary(s, d):
    hit = traverse.bfs(s.createDataFrame([("Customer:7",)], "id string"), graph_edges(s, d, ["PLACED", "CONTAINS"]), 2)
    part = table(s, d, "part").select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("node"), "p_brand")
    g = hit.join(part, "node", "left").agg(F.count(F.when(F.col("depth") == 1, 1)).alias("direct"), F.count("*").alias("total"), F.countDistinct("p_brand").alias("modules"))
    return g.withColumn("risk", traverse.impact_risk(F.col("direct"), F.lit(0), F.col("modules"), F.col("total")))


@query("group_impact", """with l as (select distinct c_nationkey as repo, o_orderpriority as contract from orders join customer on o_custkey = c_custkey where c_nationkey = 3 and o_totalprice > 200000),
 r as (select distinct s_nationkey as other, o_orderpriority as contract from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey where l_quantity > 45)
 select other, count(distinct l.contract) as hits, case when count(distinct l.contract) >= 3 then 'CRITICAL' when count(distinct l.contract) > 0 then 'MEDIUM' else 'LOW' end as risk
 from l join r on l.contract = r.contract and other <> repo group by other""")
def group_impact(s, d):
    cust = table(s, d, "customer").where("c_nationkey = 3").select("c_custkey", F.col("c_nationkey").alias("repo"))
    near = table(s, d, "orders").where("o_totalprice > 200000").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("repo", F.col("o_orderpriority").alias("contract")).distinct()
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("other"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("contract"))
    far = table(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_suppkey").join(sup, "l_suppkey").join(o, "l_orderkey").select("other", "contract").distinct()
    g = near.join(far, "contract").where("other != repo").groupBy("other").agg(F.countDistinct("contract").alias("hits"))
    return g.withColumn("risk", contracts.cross_risk(F.lit("LOW"), F.col("hits"), F.lit(0.5)))


@query("top3_per_source", """select source, sum(n_chars)::bigint as score, count(*) as n from (select source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as k from documents) where k <= 3 group by source""")
def top3_per_source(s, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(s, d, "documents").select("source", F.row_number().over(w).alias("k"), "n_chars").where("k <= 3").groupBy("source").agg(F.sum("n_chars").alias("score"), F.count("*").alias("n"))


@query("context_refs", E + """, r as (select type, 'out' as direction, dst as other from edges where src = 'Nation:3' union all select type, 'in', src from edges where dst = 'Nation:3')
 select type, direction, count(*) as n, array_to_string(list_sort(list(other)), ',') as refs from r group by all""")
def context_refs(s, d):
    me = s.createDataFrame([("Nation:3",)], "id string")
    r = pattern.expand(me, graph_edges(s, d, ["IN_NATION", "IN_REGION"]), "both")
    return r.groupBy("type", "direction").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("other")), ",").alias("refs"))


@query("service_edges", """select s_nationkey as a, c_nationkey as b, count(*) as n, array_to_string(list_sort(list(distinct l_returnflag)), ',') as via from lineitem join supplier on s_suppkey = l_suppkey
 join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where s_nationkey <> c_nationkey group by all""")
def service_edges(s, d):
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    j = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(sup, "l_suppkey").join(o, "l_orderkey").join(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("b")), "c_custkey")
    return j.where("a != b").groupBy("a", "b").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("via"))


@query("contract_dedup", """select 'topic::' || lower(trim(o_orderpriority)) as "contractId", o_orderstatus as role, count(*) as n, max(round(o_totalprice / 1000000, 6)) as confidence from orders group by all""")
def contract_dedup(s, d):
    none = F.lit(None).cast("string")
    c = table(s, d, "orders").select(F.lit("r").alias("repo"), F.concat(F.lit("topic:: "), "o_orderpriority").alias("contractId"), F.col("o_orderstatus").alias("role"), none.alias("filePath"),
                                     F.col("o_orderkey").cast("string").alias("symbolUid"), none.alias("symbolName"), none.alias("service"), none.alias("type"), none.alias("meta"), F.round(F.col("o_totalprice") / 1000000, 6).alias("confidence"))
    n = c.groupBy(routes.contract_id(F.col("contractId")).alias("contractId"), "role").agg(F.count("*").alias("n"))
    return contracts.dedup_contracts(c).select("contractId", "role", "confidence").join(n, ["contractId", "role"])


@query("topic_match", """with t as (select distinct lower(p_brand) || '.' || string_split(p_type, ' ')[1] as topic from part), l as (select distinct lower(p_brand) as topic from part where p_size > 45)
 select t.topic as transport, l.topic as listener from t join l on starts_with(t.topic, l.topic || '.')""")
def topic_match(s, d):
    p = table(s, d, "part")
    t = p.select(F.concat_ws(".", F.lower("p_brand"), F.split("p_type", " ")[0]).alias("topic")).distinct().select(F.col("topic").alias("transport_id"), "topic")
    lis = p.where("p_size > 45").select(F.lower("p_brand").alias("topic")).distinct().select(F.col("topic").alias("listener_id"), "topic")
    return contracts.match_topics(t, lis).select(F.col("transport_id").alias("transport"), F.col("listener_id").alias("listener"))


@query("route_consumers", """select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as route, count(*) as consumers, case when count(*) >= 10 then 'HIGH' when count(*) >= 4 then 'MEDIUM' else 'LOW' end as risk,
 array_to_string(list_sort(list(page_id)), ',') as pages from pages group by 1""")
def route_consumers(s, d):
    p = table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("route"))
    g = p.groupBy("route").agg(F.count("*").alias("consumers"), F.array_join(F.sort_array(F.collect_list("page_id")), ",").alias("pages"))
    return g.withColumn("risk", contracts.api_risk(F.col("consumers"), F.lit(False)))


@query("innermost_scope", """with s as (select p_partkey as id, p_brand as f, floor(p_retailprice)::bigint as a, floor(p_retailprice)::bigint + p_size * 10 as b from part), p as (select p_partkey as id, p_brand as f, floor(p_retailprice)::bigint + 20 as x from part where p_size > 25)
 select p.id as point_id, arg_min(s.id, (b - a, -a, s.id)) as scope_id from p join s on p.f = s.f and x between a and b group by p.id""")
def innermost_scope(s, d):
    p = table(s, d, "part").withColumn("at", F.floor("p_retailprice"))
    scopes = p.select(F.col("p_partkey").alias("scope_id"), F.col("p_brand").alias("file"), F.col("at").alias("start_line"), (F.col("at") + F.col("p_size") * 10).alias("end_line"))
    points = p.where("p_size > 25").select(F.col("p_partkey").alias("point_id"), F.col("p_brand").alias("file"), (F.col("at") + 20).alias("line"))
    return hierarchy.innermost(points, scopes)


@query("confident_pick", """with t as (select p_brand, p_partkey, round(p_size / 50.0::double, 4) as s from part), r as (select *, row_number() over w as k, lead(s) over w as nxt from t window w as (partition by p_brand order by s desc, p_partkey))
 select p_brand, p_partkey, s as score, s >= 0.95 and round(s - coalesce(nxt, 0), 6) > 0.09 as sure from r where k = 1""")
def confident_pick(s, d):
    t = table(s, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 50, 4).alias("score"))
    return search.confident(t, "p_brand").withColumnRenamed("id", "p_partkey")


@query("orphans", """select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') and not exists (select 1 from events where user_id = c_custkey and event_type = 'purchase')""")
def orphans(s, d):
    c = table(s, d, "customer").select("c_custkey")
    c = c.join(table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c.join(table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti")


@query("rename_edits", r"""with l as (select doc_id, string_split(text, chr(10)) as ls from documents), x as (select doc_id, unnest(range(1, len(ls) + 1)) as line, ls from l)
 select doc_id, line, md5(regexp_replace(ls[line], '\bpathetic\b', 'harmless', 'g')) as edited from x where regexp_matches(ls[line], '\bpathetic\b')""")
def rename_edits(s, d):
    x = table(s, d, "documents").where(F.contains("text", F.lit("pathetic"))).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "t"))
    return x.where(F.rlike("t", F.lit(r"\bpathetic\b"))).select("doc_id", (F.col("k") + 1).cast("long").alias("line"), F.md5(text.replace_word(F.col("t"), "pathetic", "harmless")).alias("edited"))


@query("grep_lines", r"""with l as (select source, doc_id, string_split(text, chr(10)) as ls from documents), x as (select doc_id, unnest(range(1, len(ls) + 1)) as line, ls from l)
 select doc_id, line, substr(ls[line], 1, 200) as text from x where regexp_matches(ls[line], '(?i)disgusting|worthless') order by doc_id, line limit 200""")
def grep_lines(s, d):
    x = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "t"))
    hit = x.where(F.rlike("t", F.lit("(?i)disgusting|worthless"))).select("doc_id", (F.col("k") + 1).cast("long").alias("line"), F.substring("t", 1, 200).alias("text"))
    return hit.orderBy("doc_id", "line").limit(200)  # the report's limit


@query("pattern_scan", r"""with p(pid, rx) as (values ('mail', '[a-z0-9.]+@[a-z0-9.]+'), ('card', '[0-9]{16}'), ('key', 'AKIA[A-Z0-9]{16}'))
 select doc_id, pid, len(regexp_extract_all(text, rx)) as n from documents, p where regexp_matches(text, rx)""")
def pattern_scan(s, d):
    # a fixed list of patterns: each is one expression of a single scan
    patterns = {"mail": "[a-z0-9.]+@[a-z0-9.]+", "card": "[0-9]{16}", "key": "AKIA[A-Z0-9]{16}"}
    found = F.array(*[F.struct(F.lit(k).alias("pid"), F.regexp_count("text", F.lit(v)).cast("long").alias("n")) for k, v in patterns.items()])
    return table(s, d, "documents").select("doc_id", F.inline(found)).where("n > 0")


@query("evidence_sum", """select l_partkey as candidate, round(greatest(0, least(1, sum(case l_returnflag when 'A' then 0.2 when 'R' then -0.15 else 0.05 end)))::double, 6) as score from lineitem group by l_partkey""")
def evidence_sum(s, d):
    f = F.col("l_returnflag")
    return hierarchy.capped_evidence(table(s, d, "lineitem").select(F.col("l_partkey").alias("candidate"), F.when(f == "A", 0.2).when(f == "R", -0.15).otherwise(0.05).alias("weight")))


@query("module_edges", """select r1.r_name as a, r2.r_name as b, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join nation n1 on n1.n_nationkey = c_nationkey
 join region r1 on r1.r_regionkey = n1.n_regionkey join supplier on s_suppkey = l_suppkey join nation n2 on n2.n_nationkey = s_nationkey join region r2 on r2.r_regionkey = n2.n_regionkey group by all""")
def module_edges(s, d):
    module = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    a = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(module, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("r_name").alias("a"))
    b = table(s, d, "supplier").join(module, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("b"))
    return table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(a, "l_orderkey").join(b, "l_suppkey").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("hybrid_documents", f"""with {_BM}, b as (select id, row_number() over (order by score desc, id) as k from r qualify k <= 50),
 v as (select d.doc_id as id, row_number() over (order by n_chars desc, d.doc_id) as k from documents d qualify k <= 50), u as (select id, k from b union all select id, k from v)
 select id, round(sum(1.0::double / (60 + k)), 9) as score from u group by id""")
def hybrid_documents(s, d):
    docs = table(s, d, "documents")
    b = search.ranked(search.bm25(docs, " ".join(_WORDS), "doc_id", limit=50), [F.desc("score"), F.col("id")])
    top = docs.select(F.col("doc_id").alias("id"), "n_chars").orderBy(F.desc("n_chars"), "id").limit(50)
    v = search.ranked(top, [F.desc("n_chars"), F.col("id")])
    return search.rrf({"text": b, "size": v}).select("id", "score")
