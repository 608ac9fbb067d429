"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

A rule is (host, path, verdict). It fits its host and every subdomain when the URL's path starts with the rule's
path; the longest rule (host plus path, then the smaller rule text, then block) wins. Every URL is expanded into just
the (host labels, path length) shapes that the rules have, so the expansion is bounded by the rules' shapes and not by
the URL's length. Candidates meet on 32 bits of a SHA-256 digest alone; the full digest then decides among those that
met, so digests are compared only for the few pairs whose prefixes agree.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and the default verdict; rules
with a null or empty host or null path are ignored; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import bounded_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the equi-join uses.
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _keyed(df: DataFrame, expression: Column) -> DataFrame:
    digest = F.sha2(expression, 256)
    return df.withColumn("digest", digest).withColumn("short", F.substring(digest, 1, PREFIX_HEX))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their shape, text, weight and digests; one row for each rule text."""
    kept = rules.where("host is not null and host != '' and path is not null and verdict is not null")
    shaped = kept.select(
        F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict",
    ).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shaped = shaped.select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        F.length("path").alias("prefix"),
        F.concat_ws("\n", "host", "path").alias("expression"),
    )
    return _keyed(shaped, F.col("expression")).drop("expression")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The columns of ``pages`` in a struct ``row``, with host, path, rule and verdict for each row."""
    ruled = prepare_rules(rules)
    # distinct shapes: at most (labels of the longest host) x (length of the longest path), whatever the rule count
    shapes = [(r.labels, r.prefix) for r in ruled.select("labels", "prefix").distinct().collect()]
    base = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), pages[url_col].alias("u"))
    base = base.withColumn("host", url_host(F.col("u"))).withColumn("path", url_path(F.col("u")))
    if not shapes:
        return base.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shape = F.explode(F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("prefix")) for a, b in shapes])).alias("s")
    parts = F.split("host", r"\.", -1)
    exploded = (
        base.where("host != ''").select("host", "path", parts.alias("parts"), shape)
        .where("s.labels <= size(parts) and s.prefix <= length(path)")
        .select("host", "path", F.concat_ws("\n",
            F.array_join(F.slice("parts", F.col("s.labels") * -1, F.col("s.labels")), "."), F.expr("substring(path, 1, s.prefix)")).alias("expression"))
    )
    keyed = _keyed(exploded, F.col("expression")).drop("expression").alias("k")
    side = bounded_broadcast(ruled.select("short", "digest", "rule", "verdict")).alias("r")
    met = keyed.join(side, F.col("k.short") == F.col("r.short"))
    # the confirmation stands inside the aggregate: as a filter it would become a second key of the join
    claim = F.struct((-F.length("r.rule")).alias("weight"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    best = met.groupBy("host", "path").agg(F.min(F.when(F.col("k.digest") == F.col("r.digest"), claim)).alias("best"))
    # rows without a host fit no rule; a key for each of their partitions keeps them from meeting in one task
    spread = F.when(F.col("host") == "", F.concat(F.lit("?"), F.spark_partition_id().cast("string"))).otherwise(F.col("host"))
    judged = base.withColumn("key", spread).join(
        best.where("best is not null").withColumnsRenamed({"host": "bh", "path": "bp"}), (F.col("key") == F.col("bh")) & (F.col("path") == F.col("bp")), "left"
    )
    return judged.select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )
