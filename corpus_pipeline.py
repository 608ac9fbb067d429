"""Corpus pipeline: five stages over ``documents``, each a Spark job over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and reads it back for the next stage. All stages but the last return the columns of ``documents``; the last
returns doc_id and the encoded text. Null ids, null texts, repeated rows and extra columns pass through each stage as
its operator defines. Ties: of equal texts the longest row stays, then the least id, then any one of fully equal rows; of
similar texts the row of the least id, then any one of those with that id.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, exact_dedup, sentencepiece_codec, simhash_dedup, toxicity
from weftgraph.storage import drop_paths, write_table, written_tables

#: Words of a shingle and least similarity (4 / 5) in the near-duplicate stage.
NEAR_WORDS, SIMILAR = 5, (4, 5)
#: The stage that begins a run.
FIRST = "drop_toxic"

#: Working tables of the stage that ran last on each folder of tables.
_scratch: dict[str, list[str]] = {}


def stage(work):
    """A stage: it deletes the working tables of the stage before it on the same tables, whose result has been written by then.

    The first stage deletes nothing, so that runs on other tables, and one that has ended, stay as they are."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        older = _scratch.pop(sf_dir, [])
        if work.__name__ != FIRST:
            drop_paths(spark, older)
        before = set(written_tables())
        out = work(spark, docs, sf_dir)
        _scratch[sf_dir] = [p for p in written_tables() if p not in before]
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (score below 0.5)."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.where("predicted = 0").select(*[F.col("row")[c].alias(c) for c in docs.columns])


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space: the longest, then the one of least id."""
    groups = exact_dedup.exact_groups(docs)
    return groups.where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more: the one of least id.

    SimHash signatures propose pairs; similar pairs that are farther apart are added exactly."""
    return simhash_dedup.keep_first(docs, shingle=NEAR_WORDS, similar=SIMILAR)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which fewer than one word in twenty lies in a benchmark window."""
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)
    clean = judged.where(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words")))
    return clean.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, round_trip and the piece ids of each document."""
    out = sentencepiece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["doc_id"])
    return out.select("row.doc_id", "n_pieces", "n_byte_pieces", "round_trip", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Toxicity and encoding cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = write_table(work(spark, docs, sf_dir), f"stage-{name}")
    return docs
