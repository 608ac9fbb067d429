"""Registered queries over module structure - import cycles, their order, and exported names - and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.operators import bindings, components, types
from weftgraph.plans.queries import query
from weftgraph.sources.graph_view import table

#: Orders above this price make the links of the cycle queries.
DEAR = 350_000
_IMPORTS = f"""e as (select distinct src, dst from (select o_custkey as src, lead(o_custkey) over (partition by o_orderdate order by o_orderkey) as dst from orders where o_totalprice > {DEAR})
 where dst is not null), t(src, dst) as (select src, dst from e union select t.src, e.dst from t join e on t.dst = e.src),
 n as (select src as node from e union select dst from e),
 m as (select a.src as node, min(a.dst) as least from t a join t b on a.src = b.dst and a.dst = b.src group by a.src),
 c as (select n.node, least(n.node, coalesce(m.least, n.node)) as component from n left join m on n.node = m.node)"""


def _imports(s, d):
    """Customers linked to the next customer with a dear order of the same day."""
    after = F.lead("o_custkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    dear = table(s, d, "orders").where(F.col("o_totalprice") > DEAR)
    return dear.select(F.col("o_custkey").alias("src"), after.alias("dst")).where("dst is not null").distinct()


@query("strong_components", f"with recursive {_IMPORTS} select component, count(*) as n from c group by component")
def strong_components(s, d):
    return components.strongly_connected(_imports(s, d)).groupBy("component").agg(F.count("*").alias("n"))


@query("finalisation_order", f"""with recursive {_IMPORTS},
 g as (select distinct a.component as src, b.component as dst from e join c a on e.src = a.node join c b on e.dst = b.node where a.component <> b.component),
 l(component, level) as (select distinct component, 0 from c union select g.src, l.level + 1 from l join g on g.dst = l.component)
 select c.node, c.component, max(l.level) as level from c join l on c.component = l.component group by c.node, c.component""")
def finalisation_order(s, d):
    return components.finalisation_order(_imports(s, d))


@query("export_bindings", """with recursive own as (select distinct 's' || l_suppkey as module, 'p' || l_partkey as name from lineitem where l_quantity = 50),
 wild as (select 'n' || s_nationkey as module, 's' || s_suppkey as source from supplier union select 'r' || n_regionkey, 'n' || n_nationkey from nation union select 'n' || n_nationkey, 'r' || n_regionkey from nation),
 first as (select 'n' || s_nationkey as module, min(s_suppkey) as s from supplier group by s_nationkey),
 named as (select f.module, 'best' as name, 's' || f.s as source, min(o.name) as source_name from first f join own o on o.module = 's' || f.s group by f.module, f.s
           union all select 'r' || n_regionkey, 'best', 'n' || min(n_nationkey), 'best' from nation group by n_regionkey),
 explicit as (select * from own union select module, name from named),
 b(module, name, origin, origin_name, hops) as (select module, name, module, name, 0 from own
  union select x.* from (select named.module, named.name, b.origin, b.origin_name, b.hops + 1 from b join named on named.source = b.module and named.source_name = b.name where b.hops < 6
   union all select wild.module, b.name, b.origin, b.origin_name, b.hops + 1 from b join wild on wild.source = b.module left join explicit x on x.module = wild.module and x.name = b.name where b.hops < 6 and x.module is null) x),
 k as (select module, name, origin, origin_name, min(hops) as hops from b group by all),
 w as (select *, row_number() over (partition by module, name order by hops, origin, origin_name) as place, count(*) over (partition by module, name) > 1 as clash from k)
 select module, name, origin, origin_name, hops, clash from w where place = 1""")
def export_bindings(s, d):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    own = table(s, d, "lineitem").where("l_quantity = 50").select(name("s", "l_suppkey").alias("module"), name("p", "l_partkey").alias("name")).distinct()
    supplier, nation = table(s, d, "supplier"), table(s, d, "nation")
    member, country, region = name("s", "s_suppkey"), name("n", "n_nationkey"), name("r", "n_regionkey")
    up = nation.select(region.alias("module"), country.alias("source"))
    wild = supplier.select(name("n", "s_nationkey").alias("module"), member.alias("source")).union(up).union(up.select(F.col("source").alias("module"), F.col("module").alias("source")))
    first = supplier.groupBy(name("n", "s_nationkey").alias("of")).agg(F.concat(F.lit("s"), F.min("s_suppkey").cast("string")).alias("source"))
    best = first.join(own, own["module"] == first["source"]).groupBy("of", "source").agg(F.min("name").alias("source_name"))
    best = best.select(F.col("of").alias("module"), F.lit("best").alias("name"), "source", "source_name")
    above = nation.groupBy(region.alias("module")).agg(F.concat(F.lit("n"), F.min("n_nationkey").cast("string")).alias("source"))
    named = best.union(above.select("module", F.lit("best").alias("name"), "source", F.lit("best").alias("source_name")))
    return bindings.resolve_exports(own, named, wild)


@query("propagated_types", f"""with recursive {_IMPORTS}, own as (select c_custkey as module, c_mktsegment as type from customer where c_acctbal > 5000),
 p(module, type) as (select module, type from own union select e.src, p.type from p join e on e.dst = p.module where e.src not in (select module from own))
 select module, min(type) as type, module in (select module from own) as own from p group by module""")
def propagated_types(s, d):
    c = table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("module"), F.lit("v").alias("name"), F.col("c_mktsegment").alias("type"))
    i = _imports(s, d).select(F.col("src").alias("module"), F.lit("v").alias("name"), F.col("dst").alias("source"), F.lit("v").alias("source_name"))
    return types.propagate_types(c, i).select("module", "type", F.col("level").isNull().alias("own"))
