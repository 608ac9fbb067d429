"""The registered queries of conversation repair, source mixing and divergence audit, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import conversation_repair, divergence, mixing


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repair = conversation_repair.Repair(conversation_repair.damage(rows), rows.select("conv_id"))
    return repair.summary().withColumnRenamed("conv", "conv_id")


def _best(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _op11_sql() -> str:
    """Costs and audits from the end by recursion over rows, then the repaired text by recursion over the audit's letters."""
    goes, new = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}], [2, 2, 3, 2]
    put = lambda c, letter, to: f"case when b{to}.c < 1000000 then {{'c': b{to}.c + {c}, 'a': '{letter}' || b{to}.a}} else {{'c': 1000000, 'a': '~'}} end"
    none = "{'c': 1000000, 'a': '~'}"
    direct = []
    for s in range(4):
        keep = " ".join(f"when i = '{i}' then {put('late', 'K', to)}" for i, to in goes[s].items())
        direct.append(_best(put("2", "D", s), f"case when gone then {none} {keep} else {none} end", f"case when gone then {none} else {put('1 + late', 'R', new[s])} end") + f" as d{s}")
    once = lambda s: f"{{'c': d{new[s]}.c + 5, 'a': 'I' || d{new[s]}.a}}"
    twice = lambda s: f"{{'c': d{new[new[s]]}.c + 10, 'a': 'II' || d{new[new[s]]}.a}}"
    full = ", ".join(_best(f"d{s}", once(s), twice(s)) + f" as b{s}" for s in range(4))
    return rf"""
with recursive tab as (select list_transform(range(0, 256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes from conversations),
h as (select conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as harm from o, tab),
m as (select conv_id, turn, case when harm = 4 then 'user' else role end as role,
             case when harm = 1 then '' when harm = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when harm = 3 then [0, 1] else [0] end) as copy from h where harm <> 0),
n as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k, left(role, 1) as i from m),
f as materialized (select *, lag(i) over (partition by conv_id order by k) || i as two,
       case when not regexp_matches(text, '[^ 	-
]') then 'blank' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'duplicate'
            when not regexp_matches(text, '[.!?][ 	-
]*$') then 'truncated' end as fault from n),
g as materialized (select *, fault in ('blank', 'duplicate') and fault is not null as gone, case when fault = 'truncated' then 5 else 0 end as late from f),
e as materialized (select conv_id, max(k) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
             count(*) filter (fault = 'truncated') as truncated, count(*) filter (two not in ('su', 'ua', 'au')) as illegal from g group by conv_id),
r as (select conv_id, n as k, {{'c': 0, 'a': ''}} as b0, {{'c': 10, 'a': 'II'}} as b1, {{'c': 5, 'a': 'I'}} as b2, {{'c': 0, 'a': ''}} as b3 from e
      union all
      select conv_id, k - 1, {full} from (select r.conv_id, r.k, {', '.join(direct)} from r join g on g.conv_id is not distinct from r.conv_id and g.k = r.k)),
a as materialized (select conv_id, b0.c as cost, b0.a as audit from r where k = 0),
w as (select conv_id, audit, 1 as j, 1 as k, 0 as s, null::varchar as made from a
      union all
      select w.conv_id, audit, j + 1, case when x = 'I' then w.k else w.k + 1 end,
             case when x = 'D' then s when x = 'K' then case i when 's' then 1 when 'u' then 2 else 3 end when s = 2 then 3 else 2 end,
             case when x = 'D' then made else coalesce(made || chr(10), '') || case when x = 'K' then role when s = 2 then 'assistant' else 'user' end || ':' || case when x = 'I' then '' else text end end
      from (select *, substr(audit, j, 1) as x from w where j <= length(audit)) w left join g on g.conv_id is not distinct from w.conv_id and g.k = w.k)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(a.cost, 0)::bigint as cost, coalesce(a.audit, '') as audit, sha256(coalesce(made, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join e on e.conv_id is not distinct from c.conv_id left join a on a.conv_id is not distinct from c.conv_id
left join (select conv_id, made from w where j > length(audit)) z on z.conv_id is not distinct from c.conv_id
"""


OP11_SQL = _op11_sql()


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as turn from d group by source),
w as (select source, source_size, 3 * source_size as cap, case turn when 0 then 5 when 1 then 2 else 1 end as weight from s),
f as (select *, sum(source_size) over () as all_size, sum(weight) over () as all_weight,
             coalesce(sum(cap) over o, 0) as caps, coalesce(sum(weight) over o, 0) as weighed
      from w window o as (order by cap * 10 // weight, source nulls last rows between unbounded preceding and 1 preceding)),
c as (select *, cap::hugeint * (all_weight - weighed) <= weight::hugeint * (all_size - caps) as capped from f),
l as (select max(all_size) - sum(case when capped then cap else 0 end) as remains, sum(case when capped then 0 else weight end) as open from c),
t as materialized (select source, source_size, capped, case when capped then cap::double else (weight * remains)::double / open::double end as target from c, l),
e as (select t.*, case when source_size = 0 then 0 when capped then 3 * 2147483648 else floor(target * 2147483648.0::double / source_size)::bigint end as expected,
             ('0x' || substr(md5('42:' || coalesce(source, chr(10))), 1, 7))::bigint * 8 as off from t),
r as (select doc_id, size, source_size, target, expected, off, row_number() over (partition by d.source order by size desc, doc_id) - 1 as k
      from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (size * (((k::hugeint * expected + off) % 2147483648 + expected) // 2147483648))::bigint as taken from r
"""

def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")
    return divergence.audit_divergence(docs)


OP13_SQL = r"""
with d as materialized (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
                               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as materialized (select rid, lang, source, unnest(w) as term from d),
k as materialized (select lang, term, count(*) as n from t group by lang, term having count(distinct rid) >= 30),
v as (select lang, count(*) as v, sum(n) as n from k group by lang),
c as materialized (select lang, source, term, count(*) as n from t join k using (lang, term) group by lang, source, term),
g as materialized (select a.lang, a.source, coalesce(sum(c.n), 0) as n from (select distinct lang, source from d) a left join c on a.lang = c.lang and a.source = c.source group by a.lang, a.source),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v)::hugeint as p,
                          1 + (1000000000::hugeint * (k.n + 5)) // (v.n + 5 * v.v)::hugeint as q
                   from g join v on g.lang = v.lang join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
x as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, b.source as item, coalesce(x.value, 0)::bigint as value
         from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
term as (select lang, source, term as item, (p - q)::bigint as value from p where n > 0 and p > q),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair
      union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from term)
select * from r where part = 'pair' or rank <= 50
"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair, "op12_source_mixing": op12_source_mixing, "op13_source_divergence": op13_source_divergence}
SQL = {"op11_conversation_repair": OP11_SQL, "op12_source_mixing": OP12_SQL, "op13_source_divergence": OP13_SQL}
