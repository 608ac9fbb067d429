"""SimHash near-dedup with deletion-variant signatures.

Fingerprints (64 bits) that differ in at most ``max_bits`` = 2 bits are linked. Cut into two segments, such a pair
agrees in one segment but for one bit at most, so each distinct fingerprint is indexed under 2 x 32 variants (a
segment with one bit as a wildcard); equal variants meet and the full distance is verified. A variant shared by more
than ``bucket_pairs`` fingerprints makes no pairs: its members are linked through one-bit midpoints instead (two
fingerprints within two bits share a value at one bit from both), 65 rows a fingerprint however large the group is.
Components come from the verified links; copies of one fingerprint are one node throughout.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and are linked like any other;
texts of fewer words than a shingle are one shingle; repeated rows share a component; null ids never name a component
unless all ids in it are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import jaccard_links
from weftgraph.llm.shingles import hash_set, set_hash, shingle_hashes, simhash
from weftgraph.operators.components import connected_components
from weftgraph.storage import drop_table, write_table

def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of ``text`` (UTF-8), as a signed 64-bit integer."""
    return simhash(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """Written table: rid, row (the carried columns), id, fp."""
    base = docs.select(
        F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"), docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text")
    )
    out = T.StructType([*(f for f in base.schema.fields if f.name != "text"), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], names=["row", "id", "fp"])

    return write_table(base.mapInArrow(run, out).withColumn("rid", F.monotonically_increasing_id()), "fingerprints")


def _variants(fp: Column) -> Column:
    """The 64 one-wildcard keys: which bit is the wildcard (6 bits), then its segment with that bit cleared."""

    def keys(segment: Column, base: int) -> list[Column]:
        return [(segment.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << j)))).bitwiseOR(F.lit((base + j) << 32)) for j in range(32)]

    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.array(*keys(low, 0), *keys(high, 32))


def near_links(distinct: DataFrame, max_bits: int = 2, bucket_pairs: int = 16) -> DataFrame:
    """Verified links (src, dst) between distinct fingerprints; every linked pair is connected through them."""
    if max_bits != 2:
        raise ValueError("two segments with one wildcard find distances up to 2")
    index = distinct.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    buckets = write_table(
        index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets"
    )
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    twos = buckets.where("n = 2").where(far <= max_bits).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    shared = index.join(buckets.where("n > 2").select("key", "n"), "key")
    shared = write_table(shared.select("key", "fp", "n"), "shared")
    few = shared.where(F.col("n") <= bucket_pairs)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b").where(far <= max_bits)
    hot = shared.where(F.col("n") > bucket_pairs).select("fp").distinct()
    middles = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << j) - (1 << 64 if j == 63 else 0))) for j in range(64)])
    spokes = hot.select("fp", F.explode(middles).alias("mid"))
    hubs = spokes.groupBy("mid").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("mid", "least")
    stars = spokes.join(hubs, "mid").where("fp != least").select(F.col("fp").alias("src"), F.col("least").alias("dst"))
    return twos.unionByName(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).unionByName(stars).distinct()


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """One row per document: row, id, rid, fp, root (a fingerprint), component_id (least id in the component)."""
    base = fingerprints(docs, text_col, id_col, shingle, carry)
    nodes = write_table(base.groupBy("fp").agg(F.min("id").alias("least_id")), "nodes")
    labels = connected_components(near_links(nodes.select("fp")))
    rooted = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    rooted = write_table(rooted, "rooted")
    heads = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.join(heads, "root").select(F.col("fp").alias("k"), "root", "component_id")
    return base.join(known, base.fp == known.k).drop("k")


def signatures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similar: tuple[int, int] = (4, 5)) -> DataFrame:
    """Written table: rid, row, id, text, fp, sid (hash of the set of shingles), keys (prefix of the set in the
    order of the hashes), least (how many of them a similar set shares)."""
    longs = T.ArrayType(T.LongType())
    kind = T.StructType([T.StructField("fp", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("least", T.IntegerType()), T.StructField("keys", longs)])

    @F.arrow_udf(kind)
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            fp, sid, least, keys = [], [], [], []
            for t in texts:
                hashes = shingle_hashes(t.as_py(), shingle)
                hs = hash_set(hashes)
                length, k = jaccard_links.prefix_length(len(hs), similar)
                fp.append(simhash(hashes))
                sid.append(set_hash(hs))
                least.append(k)
                keys.append(hs[:length].copy())
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(fp, pa.int64()), pa.array(sid, pa.int64()), pa.array(least, pa.int32()), lists], kind.names)

    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    held = text_col in docs.columns  # then the row has the text
    out = base.select("row", "id", *([] if held else ["text"]), sign(F.col("text").cast("binary")).alias("s")).select("*", "s.*").drop("s")
    return write_table(out.withColumn("rid", F.monotonically_increasing_id()), "signatures", compression="zstd")


def similar_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similar: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row per document: row, rid, id, sid, root (a set), component_id (least id in the component).

    Groups of texts whose shingle sets have a Jaccard similarity of ``similar`` or more. The signatures propose pairs
    within two bits, which are verified; ``jaccard_links`` adds every similar pair whose fingerprints are farther apart."""
    base = signatures(docs, text_col, id_col, shingle, similar)
    text = F.col(f"row.{text_col}") if text_col in docs.columns else F.col("text")
    nodes = write_table(base.groupBy("sid").agg(F.min("id").alias("least_id"), F.min("rid").alias("first"), F.min("fp").alias("fp")), "nodes")
    met = jaccard_links.partners_possible(base)
    first = nodes.join(met, "sid", "left_semi")
    sets = jaccard_links.shingle_sets(base.select("rid", text.alias("text")).join(first.select(F.col("first").alias("rid")), "rid", "left_semi"), shingle)
    # one set for each fingerprint, and the others of that fingerprint next to it
    heads = first.groupBy("fp").agg(F.min("sid").alias("sid"))
    close = near_links(heads.select("fp"))
    a, b = (heads.select(F.col("fp").alias(f), F.col("sid").alias(s)) for f, s in (("src", "x"), ("dst", "y")))
    pairs = close.join(a, "src").join(b, "dst").select(F.col("x").alias("src"), F.col("y").alias("dst"))
    same = first.join(heads.withColumnRenamed("sid", "dst"), "fp").where("sid != dst").select(F.col("sid").alias("src"), "dst")
    known = write_table(pairs.unionByName(same), "known")
    labels = connected_components(jaccard_links.similar_links(sets, similar, known))
    drop_table(sets)
    rooted = nodes.join(labels, nodes.sid == labels.node, "left").select(F.col("sid").alias("k"), "least_id", F.coalesce("component", "sid").alias("root"))
    rooted = write_table(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = rooted.join(ids, "root").select("k", "root", "component_id")
    return base.join(known, base.sid == known.k).select("row", "rid", "id", "sid", "root", "component_id")


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similar: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of ``docs`` with one document of each group of ``similar_groups``: the one with the least id (ties: any one row)."""
    groups = similar_groups(docs, text_col, id_col, shingle, similar)
    heads = groups.where(groups.id.eqNullSafe(groups.component_id)).groupBy("root").agg(F.min("rid").alias("rid")).select("rid")
    return groups.select("row", "rid").join(heads, "rid", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
