"""The registered queries of the ten operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from weftgraph.llm import decontaminate, exact_dedup, pii, queries_mix, secret_scan, sentencepiece_codec, simhash_dedup, suffix_dedup, token_counts, toxicity, url_filter

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).select("row.page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
with rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select page_id, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc) as k
      from q join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select q.page_id, host, path, rule, coalesce(v, 'allow') as verdict from q left join m on q.page_id = m.page_id and k = 1
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"), window=13, carry=["doc_id"])
    return out.select(
        "row.doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP3_SQL = rf"""
with d as materialized (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
win as materialized (select distinct item_id, array_to_string(w[i : i + 12], ' ') as g, least(len(w), 13) as n
                     from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from win),
dg as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
m as materialized (select doc_id, i, win.n, item_id from dg join win on dg.g = win.g and dg.n = win.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from m)) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.repeated_spans(docs, length=400, carry=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_shared_words")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    groups = simhash_dedup.near_groups(docs, shingle=3, carry=["doc_id"])
    return groups.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs, carry=["doc_id"]).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, doc_id = first_value(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, carry=["doc_id"])
    return scored.select("row.doc_id", (toxicity.fold(F.col("row.doc_id")) == 0).alias("held_out"), "score", "predicted")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs, carry=["doc_id"])
    base = F.filter("spans", lambda s: s.kind < 3)

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    return found.select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(base, secret_scan.KINDS), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans"), secret_scan.KINDS).alias("spans"),
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"])
    return out.select("row.doc_id", "n_pieces", "n_byte_pieces", "round_trip", "ids")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, carry=["doc_id"])

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    return found.select(
        "row.doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.BASE)],
        F.sha2(secret_scan.span_text(F.filter("spans", lambda s: s.kind < len(pii.BASE)), pii.KINDS), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans"), pii.KINDS).alias("spans"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), carry=["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash": op7_simhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_token_counts,
    **queries_mix.QUERIES,
}
SQL = {"op1_url_filters": OP1_SQL, "op3_decontamination": OP3_SQL, "op8_exact_dedup": OP8_SQL, **queries_mix.SQL}
