"""Benchmark decontamination by a prefix-filtered join of word shingles, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window). A window can only occur
where all of its shingles do, so its necessary prefix is one shingle: the rarest by corpus frequency, counted over all
documents. Document shingles meet the prefix shingles; the position bound (the window starts at 0 or later) and the
length bound (it ends inside the document) prune, and the words of the window are compared one by one.

Defined results: null texts and texts without words have no words and no hits; items with null ids or without words
are ignored, repeated items count once; repeated documents are judged one by one; without items nothing is hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.storage import bounded_broadcast, write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words_of(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def item_windows(items: DataFrame, window: int, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, win, len) and which items have them (wid, item_id)."""
    split = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    wins = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    wins = write_table(wins.withColumn("wid", F.sha2(F.array_join("win", " "), 256)).distinct(), "item_windows")
    return wins.select("wid", "win", F.size("win").alias("len")).distinct(), wins.select("wid", "item_id").distinct()


def _grams(df: DataFrame, words: str, size: int, *keep: str) -> DataFrame:
    """(keep, pos, h): the hash of each run of ``size`` words."""
    zipped = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(F.size(words) - size + 1, F.lit(0))).alias(f"w{k}") for k in range(size)])
    rows = df.select(*keep, F.posexplode(zipped).alias("pos", "g"))
    return rows.select(*keep, "pos", F.xxhash64(F.lit(size), *[F.col(f"g.w{k}") for k in range(size)]).alias("h"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", carry: list[str] | None = None) -> DataFrame:
    """One row per document: row, n_words, n_hit, n_items, item_ids (sorted strings)."""
    base = write_table(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"),
            words_of(docs[text_col]).alias("words"),
        ),
        "words",
    )
    wins, owners = item_windows(items, window, item_text, item_id)
    wins = write_table(wins, "windows")
    sizes = sorted({min(SHINGLE, r.len) for r in wins.select("len").distinct().collect()})  # 1 to SHINGLE
    if sizes:
        grams = reduce(DataFrame.unionByName, [_grams(wins.where(F.least(F.lit(SHINGLE), "len") == s), "win", s, "wid") for s in sizes])
        grams = write_table(grams, "window_grams")
        wanted = bounded_broadcast(grams.select("h").distinct())
        found = reduce(DataFrame.unionByName, [_grams(base, "words", s, "rid") for s in sizes])
        hits = write_table(found.join(wanted, "h", "left_semi"), "hits")
        seen = hits.groupBy("h").agg(F.count("*").alias("freq"))
        # a window with a shingle that no document has cannot occur
        ranked = grams.join(seen, "h", "left").groupBy("wid").agg(
            F.min(F.coalesce("freq", F.lit(0))).alias("least"), F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "pos", "h")).alias("p")
        )
        prefix = ranked.where("least > 0").select("wid", F.col("p.pos").alias("offset"), F.col("p.h").alias("h"))
        prefix = write_table(prefix.join(wins, "wid"), "prefixes")
        near = hits.join(bounded_broadcast(prefix), "h").select("rid", F.struct((F.col("pos") - F.col("offset")).alias("at"), "wid", "win", "len").alias("c"))
        near = near.where("c.at >= 0").groupBy("rid").agg(F.collect_list("c").alias("cs"))
        judged = base.join(near, "rid").select(
            "rid",
            F.filter("cs", lambda c: (c.at + c.len <= F.size("words")) & (F.slice("words", c.at + 1, c.len) == c.win)).alias("cs"),
        ).select(
            "rid",
            F.size(F.array_distinct(F.flatten(F.transform("cs", lambda c: F.sequence(c.at, c.at + c.len - 1))))).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("cs", lambda c: c.wid)).alias("wids"),
        ).where("n_hit > 0")
        judged = write_table(judged, "judged")
        named = judged.select("rid", F.explode("wids").alias("wid")).join(bounded_broadcast(owners), "wid").select("rid", "item_id").distinct()
        named = named.groupBy("rid").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))
        dirty = judged.select("rid", "n_hit").join(named, "rid")
        out = base.select("rid", "row", F.size("words").cast("long").alias("n_words")).join(dirty, "rid", "left")
    else:
        out = base.select("rid", "row", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("item_ids"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: at least one hit word and at least one word in twenty hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)
