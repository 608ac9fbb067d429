"""Each pipeline stage against brute force on its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_dedup_ops import brute_hits
from tests.llm.test_jaccard_links import brute_kept


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (5000, None, None, None, None), (5001, "", "en", "s", 0), (5001, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns if k < 4 else out.columns[0] == "doc_id"
        out.write.parquet(path := f"{tmp_path}/{k}")
        docs = spark.read.schema(out.schema).parquet(path)
        after = docs.collect()
        if name == "toxicity":
            assert 0.8 * len(before) < len(after) <= len(before)
        if name == "exact_dedup":
            norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
            assert len(after) == len({norm(r) for r in before}) == len({norm(r) for r in after})
        if name == "near_dedup":
            assert sorted(map(str, after)) == brute_kept(before)
        if name == "decontamination":
            hits = brute_hits([(r.doc_id, r.text) for r in before], items, 13)
            assert sorted(r.text or "" for r in after) == sorted(r.text or "" for r, (n, h, _) in zip(before, hits) if not (h and 20 * h >= n))
    assert len(after) == len(before) and all(r.round_trip for r in after)


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.lit(False))
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{tmp_path}/e{k}")
        docs = spark.read.schema(out.schema).parquet(path)
        assert docs.count() == 0
