"""Registered queries over scopes, inclusion and staged lookup, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.functions import tables
from weftgraph.operators import inclusion, lookup, scopes
from weftgraph.plans.queries import query
from weftgraph.sources.graph_view import table

_SCOPES = """s as (select 'c' || o_custkey as file, o_orderkey as id, date_diff('day', date '1990-01-01', o_orderdate::date) as a,
 date_diff('day', date '1990-01-01', o_orderdate::date) + floor(o_totalprice / 1000)::int as b from orders)"""


def _scopes(s, d):
    start = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01"))
    end = start + F.floor(F.col("o_totalprice") / 1000).cast("int")
    return table(s, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderkey").alias("scope_id"), start.alias("start_line"), F.lit(0).alias("start_col"), end.alias("end_line"), F.lit(0).alias("end_col"),
    )


@query("scope_tree", f"""with {_SCOPES} select x.file, x.id as scope_id, arg_max(y.id, (y.a, -y.b, y.id)) as parent, count(y.id)::int as depth
 from s x left join s y on x.file = y.file and y.a <= x.a and y.b >= x.b and (y.a, -y.b, y.id) < (x.a, -x.b, x.id) group by x.file, x.id""")
def scope_tree(s, d):
    return scopes.scope_tree(_scopes(s, d)).select("file", "scope_id", "parent", "depth")


@query("position_index", f"""with {_SCOPES} select x.file, x.id as point_id, arg_max(y.id, (y.a, -y.b, y.id)) as scope_id from s x left join s y on x.file = y.file and y.a <= x.b + 7 and y.b >= x.b + 7 group by x.file, x.id""")
def position_index(s, d):
    points = _scopes(s, d).select("file", F.col("scope_id").alias("point_id"), (F.col("end_line") + 7).alias("line"), F.lit(0).alias("col"))
    return scopes.innermost_at(points, _scopes(s, d))


@query("copy_expansion", r"""with recursive kinds as (select distinct 'B' || substr(p_brand, 7) as book, p_type from part),
 books(book, line, own) as (select distinct book, 1, 'SIZE of ' || book from kinds union all select book, (1 + row_number() over (partition by book order by p_type))::int, 'copy "T-' || p_type || '".' from kinds
  union all select distinct 'T-' || p_type, 1, 'SIZE in ' || p_type from kinds union all select 'T-' || p_type, 2, '  COPY ' || min(book) || '.' from kinds group by p_type),
 x(program, place, text, source, line, depth, stack) as (
  select 's' || s_suppkey, k::varchar, case k when 1 then s_name else 'COPY B' || s_nationkey || ' REPLACING ==SIZE== BY ==s' || s_suppkey || '==.' end, 's' || s_suppkey, k, 0, []::varchar[] from supplier, (values (1), (2)) v(k)
  union all select program, place || '.' || b.line, own, book, b.line, depth + 1, list_append(stack, book) from (select *, upper(regexp_extract(text, '(?i)^\s*COPY\s+"?([A-Z0-9_-]+)"?', 1)) as name from x) n join books b on b.book = n.name
   where depth < 10 and not list_contains(stack, name)),
 n as (select *, upper(regexp_extract(text, '(?i)^\s*COPY\s+"?([A-Z0-9_-]+)"?', 1)) as name from x),
 m as (select *, case when name = '' then null when name not in (select book from books) then 'missing' when list_contains(stack, name) then 'circular' when depth >= 10 then 'too deep' end as note from n)
 select program, place, case when depth > 0 then replace(text, 'SIZE', program) else text end as text, source, line, depth, note from m where name = '' or note is not null""")
def copy_expansion(s, d):
    kinds = table(s, d, "part").select(F.concat(F.lit("B"), F.substring("p_brand", 7, 9)).alias("name"), "p_type").distinct()
    kind = F.concat(F.lit("T-"), F.col("p_type"))
    at = F.row_number().over(Window.partitionBy("name").orderBy("p_type")) + 1
    books = kinds.select("name", F.lit(1).alias("line"), F.concat(F.lit("SIZE of "), F.col("name")).alias("text")).distinct()
    books = books.union(kinds.select("name", at, F.concat(F.lit('copy "'), kind, F.lit('".'))))
    books = books.union(kinds.select(kind, F.lit(1), F.concat(F.lit("SIZE in "), F.col("p_type"))).distinct())
    books = books.union(kinds.groupBy(kind.alias("k")).agg(F.min("name").alias("first")).select("k", F.lit(2), F.concat(F.lit("  COPY "), F.col("first"), F.lit("."))))
    supplier = table(s, d, "supplier")
    me = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    copy = F.concat(F.lit("COPY B"), F.col("s_nationkey").cast("string"), F.lit(" REPLACING ==SIZE== BY =="), me, F.lit("==."))
    programs = supplier.select(me.alias("program"), F.lit(1).alias("line"), F.col("s_name").alias("text")).union(supplier.select(me, F.lit(2), copy))
    done = inclusion.expand_copies(programs, books)
    return done.select("program", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), "text", "source", "line", "depth", "note")


_REFERENCES = """site as (select o_orderkey as site, c_nationkey as n, n_regionkey as r, 'k' || (o_orderkey % 40) as name, o_orderkey % 3 as arity,
  case when o_orderstatus = 'F' then case when o_orderkey % 2 = 0 then 'me' else 'me.next' end end as receiver from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
 nb as (select n_nationkey as n, 'k' || n_nationkey as name, 'd' || n_nationkey as def, 0.55 as w from nation union select s_nationkey, 'k' || (s_suppkey % 40), 's' || s_suppkey, 0.45 from supplier where s_acctbal > 0),
 rb as (select distinct n_regionkey as r, 'k' || (s_suppkey % 40) as name, 's' || s_suppkey as def from supplier join nation on s_nationkey = n_nationkey),
 defs as (select 'p' || p_partkey as def, 'T' || (p_partkey % 5) || '.k' || (p_partkey % 40) as qualified, p_size % 3 as lo, p_size % 3 as hi from part
  union all select 's' || s_suppkey, 'sup.k' || (s_suppkey % 40), null, null from supplier union all select 'd' || n_nationkey, null, 0, 1 from nation),
 mem as (select p_partkey % 5 as j, 'k' || (p_partkey % 40) as name, 'p' || p_partkey as def from part where p_size > 25),
 own as (select site, name, case when receiver = 'me' then n % 5 else (n % 5 + 2) % 5 end as i from site where receiver is not null),
 m0 as (select site, def, j - i as depth, min(j - i) over (partition by site) as least from own join mem on mem.name = own.name and mem.j >= own.i),
 recv as (select distinct site, def, 'receiver' as stage, case depth when 0 then 0.70 when 1 then 0.42 when 2 then 0.36 when 3 then 0.32 else 0.30 end as w, depth as far from m0 where depth = least),
 l1 as (select site, def, 'lexical' as stage, max(w) - 0.02 as w, 1 as far from site join nb using (n, name) where receiver is null group by site, def),
 l2 as (select site, def, 'lexical' as stage, 0.26 as w, 2 as far from site join rb using (r, name) where receiver is null and not exists (select 1 from nb where nb.n = site.n and nb.name = site.name)),
 got as (select * from recv union all select * from l1 union all select * from l2),
 whole as (select site, def, 'global' as stage, 0.10 as w, 0 as far from site join defs on string_split(qualified, '.')[-1] = name where receiver is null and site not in (select site from got)),
 cand as (select * from got union all select * from whole),
 ar as (select c.*, case when lo is null then 0 when arity between lo and hi then 1 else -1 end as fit from cand c join site using (site) left join defs using (def)),
 nar as (select *, max(fit = 1) over (partition by site) as fits from ar),
 sc as (select site, def, stage, round(greatest(0, least(1, w + case fit when 1 then 0.10 when -1 then -0.15 else 0 end))::double, 6) as confidence, far from nar where not fits or fit <> -1),
 rk as (select *, row_number() over (partition by site order by round(confidence / 0.001) desc, far, def) as rank from sc)"""


def _references(s, d):
    """Orders as call sites in the scopes of customers, nations and regions; suppliers and parts as what they may mean."""
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    col, k = F.col, lambda c: name("k", F.col(c) % 40)
    nation, customer, supplier, part = (table(s, d, t) for t in ("nation", "customer", "supplier", "part"))
    receiver = F.when(col("o_orderstatus") == "F", F.when(col("o_orderkey") % 2 == 0, "me").otherwise("me.next"))
    sites = table(s, d, "orders").select(col("o_orderkey").alias("site"), name("c", col("o_custkey")).alias("scope"), k("o_orderkey").alias("name"), receiver.alias("receiver"), (col("o_orderkey") % 3).cast("int").alias("arity"))
    tree = customer.select(name("c", col("c_custkey")).alias("scope"), name("n", col("c_nationkey")).alias("parent"))
    tree = tree.union(nation.select(name("n", col("n_nationkey")), name("r", col("n_regionkey")))).union(nation.select(name("r", col("n_regionkey")), F.lit(None).cast("string")).distinct())
    me = name("s", col("s_suppkey"))
    bound = nation.select(name("n", col("n_nationkey")).alias("scope"), k("n_nationkey").alias("name"), name("d", col("n_nationkey")).alias("def"), F.lit("local").alias("origin"))
    bound = bound.union(supplier.where("s_acctbal > 0").select(name("n", col("s_nationkey")), k("s_suppkey"), me, F.lit("import")))
    bound = bound.union(supplier.join(nation, col("s_nationkey") == col("n_nationkey")).select(name("r", col("n_regionkey")), k("s_suppkey"), me, F.lit("wildcard")))
    types = nation.select(name("n", col("n_nationkey")).alias("scope"), F.lit("me").alias("name"), name("T", col("n_nationkey") % 5).alias("owner"))
    owner = part.select((col("p_partkey") % 5).alias("i")).distinct()
    order = owner.select("i", F.explode(F.sequence(col("i"), F.lit(4).cast("long"))).alias("j")).select(name("T", col("i")).alias("owner"), name("T", col("j")).alias("ancestor"), (col("j") - col("i")).cast("int").alias("depth"))
    members = part.where("p_size > 25").select(name("T", col("p_partkey") % 5).alias("owner"), k("p_partkey").alias("name"), name("p", col("p_partkey")).alias("def"))
    members = members.union(owner.select(name("T", col("i")), F.lit("next"), name("next", col("i"))))
    arity, none = (col("p_size") % 3).alias("min_arity"), F.lit(None).cast("int")
    defs = part.select(name("p", col("p_partkey")).alias("def"), F.concat(name("T", col("p_partkey") % 5), F.lit("."), k("p_partkey")).alias("qualified"), arity, arity.alias("max_arity"), F.lit(None).cast("string").alias("returns"))
    defs = defs.union(supplier.select(me, F.concat(F.lit("sup."), k("s_suppkey")), none, none, F.lit(None))).union(nation.select(name("d", col("n_nationkey")), F.lit(None), F.lit(0), F.lit(1), F.lit(None)))
    defs = defs.union(owner.select(name("next", col("i")), F.lit(None), none, none, name("T", (col("i") + 2) % 5)))
    return sites, tree, bound, types, members, order, defs


@query("resolved_references", f"with {_REFERENCES} select site, def, stage, confidence from rk where rank = 1")
def resolved_references(s, d):
    return lookup.best_references(*_references(s, d))


@query("reference_stages", f"with {_REFERENCES} select stage, count(distinct site) as sites, count(*) as candidates, round(avg(confidence), 4) as mean from sc group by stage")
def reference_stages(s, d):
    return lookup.reference_summary(*_references(s, d)).withColumn("mean", F.round("mean", 4))


@query("lateral_chunks", "select doc_id, i::int as chunk, (i * 1080)::int as start, least(i * 1080 + 1200, n)::int as stop from (select doc_id, length(text) as n from documents where text is not null) d, unnest(range(0, 1 + greatest(0, ceil((n - 1200) / 1080.0))::bigint)) u(i)")
def lateral_chunks(s, d):
    tables.register(s)
    return s.sql("select d.doc_id, c.chunk, c.start, c.stop from {docs} d, lateral weft_chunks(d.text, 1200, 120) c", docs=table(s, d, "documents").select("doc_id", "text"))


@query("table_top", "select c_custkey, c_nationkey, c_acctbal, k::int as rank from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as k from customer) where k <= 3")
def table_top(s, d):
    tables.register(s)
    table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").createOrReplaceTempView("weft_customers")
    return s.sql("select * from weft_top(table(weft_customers) partition by c_nationkey order by (c_acctbal desc, c_custkey), 3)")


@query("table_sessions", """with e as (select event_id, user_id, epoch_us(ts) / 60000000.0 as minute from events), g as (select *, minute - lag(minute) over (partition by user_id order by minute, event_id) > 600 as fresh from e),
 n as (select *, sum(case when fresh then 1 else 0 end) over (partition by user_id order by minute, event_id) as session from g) select user_id, session::int as session, count(*) as n from n group by all""")
def table_sessions(s, d):
    tables.register(s)
    minute = (F.unix_micros(F.col("ts").cast("timestamp")) / 60000000.0).alias("minute")
    table(s, d, "events").select("event_id", "user_id", minute).createOrReplaceTempView("weft_events")
    rows = s.sql("select * from weft_sessions(table(weft_events) partition by user_id order by (minute, event_id), 'minute', 600d)")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"))
