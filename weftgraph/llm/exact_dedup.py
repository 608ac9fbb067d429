"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Each normalised text is cut at content-defined places; equal texts therefore get equal recipes (ordered lists of chunk
identifiers). A chunk's identifier is its 64-bit hash once the chunk dictionary has shown that no other chunk shares
it; documents that hold a hash with two contents use SHA-256 identifiers instead. Only distinct chunks of each map
task move; long documents are then compared as recipes.

Defined results: null text counts as empty, all empty texts are one group; of equal texts the longest original stays,
then the smallest id (null ids last), then one row of fully equal ones; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import write_table

#: A cut follows two characters of this class (low four bits 3), 256 to 2048 characters after the last one.
CUT = r"[\x23\x33\x43\x53\x63\x73\xE3\xF3]"
CHUNK = rf"(?s).{{254,2046}}?{CUT}{CUT}|.{{1,2048}}"
SPACE = r"[\x20\x09-\x0D]+"


def chunked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Written table: rid, row (the carried columns), id, n_chars, sha256, chunks."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(
        F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"),
        docs[id_col].alias("id"),
        F.length(text).alias("n_chars"),
        F.regexp_replace(text, SPACE, "").alias("norm"),
    )
    return write_table(
        base.select(
            F.monotonically_increasing_id().alias("rid"), "row", "id", "n_chars",
            F.sha2("norm", 256).alias("sha256"),
            F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"),
        ),
        "chunks",
    )


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per document: row, id, text_sha256, keep_id, group_size, kept."""
    base = chunked(docs, text_col, id_col, carry)
    occurrences = base.select("rid", F.explode("chunks").alias("chunk"))
    dictionary = occurrences.select(F.xxhash64("chunk").alias("h"), "chunk").distinct()
    clashes = dictionary.groupBy("h").count().where("count > 1").select("h")
    clashes = write_table(clashes, "clashes")
    recipe = F.array_join(F.transform("chunks", lambda c: F.hex(F.xxhash64(c))), ",")
    slim = base.select("rid", "row", "id", "n_chars", "sha256", "chunks")
    if clashes.isEmpty():
        recipes = slim.withColumn("recipe", recipe).drop("chunks")
    else:
        hit = occurrences.join(clashes, F.xxhash64("chunk") == F.col("h"), "left_semi").select("rid").distinct().withColumn("clash", F.lit(True))
        exact = F.array_join(F.transform("chunks", lambda c: F.sha2(c, 256)), ",")
        recipes = slim.join(hit, "rid", "left").withColumn("recipe", F.when(F.col("clash"), exact).otherwise(recipe)).drop("chunks", "clash")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    groups = recipes.groupBy("recipe").agg(F.count("*").alias("size"), F.min(order).alias("first")).where("size > 1")
    groups = groups.select(F.col("recipe").alias("g"), "size", F.col("first.id").alias("first_id"), F.col("first.rid").alias("first_rid"))
    joined = recipes.join(groups, F.col("recipe") == F.col("g"), "left")
    return joined.select(
        "row",
        "id",
        F.when(F.col("g").isNull(), F.col("id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("g").isNull() | (F.col("rid") == F.col("first_rid"))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )
