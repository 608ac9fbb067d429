"""Registered queries over stored indexes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import search
from weftgraph.operators.text_index import TextIndex
from weftgraph.operators.vector_index import VectorIndex, scratch_index_path
from weftgraph.plans.queries import _BM, _COS, _WORDS, query
from weftgraph.sources.graph_view import table


def _vectors(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


@query("vector_index_topk", f"with {_COS} select qid as query_id, vec_id as id, round(dist, 6) as distance, rank from k where rank <= 10")
def vector_index_topk(s, d):
    """The proven answer: what the codes and lists cannot rule out is compared exactly."""
    v, q = _vectors(s, d)
    index = VectorIndex.create(v, scratch_index_path(s, "vectors"))
    return index.search(q, 10, complete=True).withColumn("distance", F.round("distance", 6))


@query("vector_index_recall", "select count(*) as queries, true as enough from embeddings where vec_id % 100 = 0")
def vector_index_recall(s, d):
    """Queries, and whether the quick answer of production parameters holds nine tenths of the true neighbours."""
    v, q = _vectors(s, d)
    quick = VectorIndex.create(v, scratch_index_path(s, "vectors")).search(q, 10)
    true = search.nearest(v, q, 10).select("query_id", "id", F.lit(1).alias("hit"))
    found = true.join(quick.select("query_id", "id", F.lit(1).alias("got")), ["query_id", "id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), (F.count("got") >= 0.9 * F.count("*")).alias("enough"))


@query("text_index_topk", f"with {_BM} select id, score from r order by score desc, id limit 20")
def text_index_topk(s, d):
    index = TextIndex.create(table(s, d, "documents"), scratch_index_path(s, "texts"), "doc_id")
    return index.search(" ".join(_WORDS), 20)
