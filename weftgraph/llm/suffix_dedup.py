"""Repeated-substring dedup on a prefix-free parse.

Every byte covered by a ``length``-byte string that also starts anywhere else in the corpus is removed. A rolling hash
of 16 bytes triggers phrase boundaries at about one position in 64, by content alone, so equal strings are parsed
alike wherever they stand. The windows (strings of ``length`` bytes) that share their first trigger form a segment;
its core, a stretch at that trigger that all its windows contain, is its place in the dictionary, and its whole extent
is its parse entry. In place of a global suffix order, which only serves to bring equal suffixes together, equal cores
and extents are brought together by hash partitioning:

* a core that occurs once rules its windows out; a core whose occurrences all have one extent settles them wholly;
* an extent that occurs twice settles its windows; of each distinct extent of a core one representative stays open;
* open segments are cut into blocks of ``FINE`` windows at places counted from the trigger, with cores and extents of
  their own, by the same rules; only the windows of blocks that stay open are listed one by one, and windows that occur
  twice among the representatives are repeated, too.

So long copies move as segments, and single windows are listed only where copies begin and end. Matching is by two
independent 64-bit hashes (core and extent, or core and window; two bases and two letter tables); bytes themselves are
not compared. Matches never cross documents.

Besides, words are counted that stand in a passage of ``PASSAGE`` words which another document has, too, wherever it begins
and whatever its length in bytes. Windows of so many words are parsed likewise: neighbours with the same least gram of
``WORD_GRAM`` words form a segment, that gram is its core. Equal windows have equal cores, so cores of one document rule
theirs out, and extents that two documents have settle theirs; the windows of the others are listed.

Defined results: null counts as empty; texts below ``length`` bytes are kept whole; repeated rows remove each other's
bytes; texts without triggers are compared window by window; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.storage import drop_table, write_table

GRAM, ONE_IN = 16, 64
#: Windows of a block.
FINE = 16
#: Words of a passage, and of the grams of which its least is the core.
PASSAGE, WORD_GRAM = 51, 12
#: Texts are parsed in blocks of so many window starts.
BLOCK = 1 << 20
#: Odd multipliers of the two hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LETTERS = [_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(x)) for x in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(which: int, inverse: bool, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base or of its inverse."""
    key = which, inverse
    if key not in _powers or len(_powers[key]) < n:
        base = _BASES[which]
        steps = np.full(1 << max(1, n - 1).bit_length(), pow(base, -1, 1 << 64) if inverse else base, dtype=np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


class _Hashes:
    """Hashes of any substring of a block (bytes, or hashes of words), from prefix sums; ``which`` tells which of the two."""

    def __init__(self, data: np.ndarray, which: int):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        letters = _LETTERS[which][data] if data.dtype == np.uint8 else data
        np.cumsum(letters * _power(which, False, len(data)), out=self.sums[1:])
        self.down = _power(which, True, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return _mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(salt))


def _block_segments(data: np.ndarray, windows: int, length: int) -> tuple[np.ndarray, ...]:
    """Segments (lo, n, pad, core, whole) of the window starts 0 to ``windows`` of a block; pad counts the windows that the text's end cuts off."""
    h, other = _Hashes(data, 0), _Hashes(data, 1)
    grams = np.arange(len(data) - GRAM + 1)
    t = np.flatnonzero(h.of(grams, grams + GRAM, 1) < np.uint64((1 << 64) // ONE_IN))
    far, half = length - GRAM, length // 2
    last = windows - 1
    before = np.concatenate([[-1], t[:-1]]) + 1 if len(t) else t  # the first start whose first trigger is t
    near_lo, near_hi = np.maximum(before, t - half), np.minimum(t, last)
    wide_lo, wide_hi = np.maximum(before, t - far), np.minimum(t - half - 1, last)
    near, wide = near_lo <= near_hi, wide_lo <= wide_hi
    # starts without a trigger in reach: before t - far, and after the last trigger
    bare_lo = np.concatenate([before, [t[-1] + 1 if len(t) else 0]])
    bare_hi = np.concatenate([np.minimum(t - far - 1, last), [last]])
    bare = [np.arange(a, b + 1) for a, b in zip(bare_lo, bare_hi) if a <= b]
    alone = np.concatenate(bare) if bare else np.zeros(0, np.int64)
    lo = np.concatenate([near_lo[near], wide_lo[wide], alone])
    hi = np.concatenate([near_hi[near], wide_hi[wide], alone])
    at, late = t[near], t[wide]
    core = np.concatenate([h.of(at, at + half, 2), h.of(late - half, late + GRAM, 3), h.of(alone, alone + length, 4)])
    pad = np.concatenate([at - near_hi[near], late - half - 1 - wide_hi[wide], np.zeros(len(alone), np.int64)])
    return lo, hi - lo + 1, pad, core, other.of(lo, hi + length, 5)


def segments(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(lo, n, pad, core, whole) arrays for all windows of ``text``."""
    total = len(text) - length + 1
    if total <= 0:
        return (*(np.zeros(0, np.int32) for _ in range(3)), *(np.zeros(0, np.int64) for _ in range(2)))
    data, parts = np.frombuffer(text, np.uint8), []
    for s in range(0, total, BLOCK):
        here = min(BLOCK, total - s)
        # triggers up to `length` after a start count, so the block reaches one length beyond its last window's start
        lo, *rest = _block_segments(data[s : s + here + length - 1], here, length)
        parts.append((lo + s, *rest))
    lo, n, pad, core, whole = (np.concatenate(x) for x in zip(*parts))
    return lo.astype(np.int32), n.astype(np.int32), pad.astype(np.int32), core.view(np.int64), whole.view(np.int64)


def _stretches(lo: np.ndarray, n: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of text (start, end) that runs of windows cover together, with the places of their runs."""
    if not len(lo):
        return
    order = np.argsort(lo, kind="stable")
    ends = np.maximum.accumulate((lo + n)[order]) + length - 1
    cuts = np.flatnonzero(np.concatenate([[True], lo[order][1:] > ends[:-1]]))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(lo[order[a]]), int(ends[b - 1]), order[a:b]


def blocks(text: bytes, lo: np.ndarray, n: np.ndarray, pad: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Blocks (lo, n, pad, core, whole) of segments: FINE windows each, at places counted back from the last window that the
    segment would have in a longer text, so that equal windows of two texts are in blocks of the same place.

    A block's core is what all its FINE windows have in common, whether the text has them all or not."""
    data, parts = np.frombuffer(text, np.uint8), []
    for first, end, which in _stretches(lo, n, length):
        h, other = _Hashes(data[first:end], 0), _Hashes(data[first:end], 1)
        for k in which:
            low, high = lo[k] - first, lo[k] + n[k] - 1 - first
            whole = np.arange(high + pad[k] - FINE + 1, low - FINE, -FINE)  # where whole blocks would begin
            at, top = np.maximum(whole, low), np.minimum(whole + FINE - 1, high)
            held = at <= top
            whole, at, top = whole[held], at[held], top[held]
            parts.append((at + first, top - at + 1, np.zeros(len(at), np.int64), h.of(whole + FINE - 1, whole + length, 7).view(np.int64), other.of(at, top + length, 8).view(np.int64)))
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5


def window_hashes(text: bytes, lo: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the blocks lo to lo + n: their starts and both hashes of each."""
    data, none, parts = np.frombuffer(text, np.uint8), np.zeros(0, np.int64), []
    for first, end, which in _stretches(lo, n, length):
        h, other = _Hashes(data[first:end], 0), _Hashes(data[first:end], 1)
        x = np.unique(np.concatenate([np.arange(lo[k], lo[k] + n[k]) for k in which])) - first
        parts.append((x + first, h.of(x, x + length, 6).view(np.int64), other.of(x, x + length, 9).view(np.int64)))
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (none, none, none)


_GAPS = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, in order; white space only parts them."""
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(_GAPS[data], prepend=True, append=True))
    at, end, parts, step = edges[::2], edges[1::2], [np.zeros(0, np.uint64)], max(1, BLOCK // 8)
    for k in range(0, len(at), step):
        a, b = at[k : k + step], end[k : k + step]
        parts.append(_Hashes(data[a[0] : b[-1]], 0).of(a - a[0], b - a[0], 10))
    return np.concatenate(parts)


def _least(x: np.ndarray, reach: int) -> np.ndarray:
    """The least of each ``reach`` neighbours."""
    wide = 1
    while 2 * wide <= reach:
        x, wide = np.minimum(x[:-wide], x[wide:]), 2 * wide
    return np.minimum(x[: len(x) - (reach - wide)], x[reach - wide :])


def passages(text: bytes) -> tuple[np.ndarray, ...]:
    """Segments (lo, n, core, whole) of the windows of PASSAGE words, counted in words: neighbours with the same least gram."""
    words = word_hashes(text)
    total = len(words) - PASSAGE + 1
    if total <= 0:
        return (*(np.zeros(0, np.int32) for _ in range(2)), *(np.zeros(0, np.int64) for _ in range(2)))
    grams = np.arange(len(words) - WORD_GRAM + 1)
    core = _least(_Hashes(words, 0).of(grams, grams + WORD_GRAM, 11), PASSAGE - WORD_GRAM + 1)
    lo = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
    n = np.diff(np.append(lo, total))
    whole = _Hashes(words, 1).of(lo, lo + n + PASSAGE - 1, 12)
    return lo.astype(np.int32), n.astype(np.int32), core[lo].view(np.int64), whole.view(np.int64)


def passage_hashes(text: bytes, lo: np.ndarray, n: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of the segments lo to lo + n: their starts, both hashes, and ``many`` of their segment."""
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    words = word_hashes(text)
    x = np.concatenate([np.arange(a, a + k) for a, k in zip(lo, n)])
    a, b = (_Hashes(words, which).of(x, x + PASSAGE, 13 + which).view(np.int64) for which in (0, 1))
    return x, a, b, np.repeat(many.astype(bool), n)


def covered(starts_lo: np.ndarray, counts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows that start in lo to lo + count."""
    order = np.argsort(starts_lo, kind="stable")
    lo, end = starts_lo[order].astype(np.int64), (starts_lo + counts)[order].astype(np.int64) + length - 1
    if not len(lo):
        return []
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return list(zip(lo[first].tolist(), reach[np.concatenate([first[1:] - 1, [len(lo) - 1]])].tolist()))


def _kept_sha(text: bytes, spans: list[tuple[int, int]]) -> str:
    digest, at = hashlib.sha256(), 0
    view = memoryview(text)
    for a, b in spans:
        digest.update(view[at:a])
        at = b
    digest.update(view[at:])
    return digest.hexdigest()


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of ``text`` without the spans."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


_INTS, _LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
_I32 = pa.list_(pa.int32())


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def _settled(rows: DataFrame, label: str) -> DataFrame:
    """(rid, hits, open) of segments or blocks (rid, lo, n, pad, core, whole): those whose windows all occur again, and the open representatives.

    Cores that occur once rule their windows out. Counts combine before each shuffle, so a core that a third of the texts
    has is no hot task there; the joins are split by adaptive execution where one still is."""
    cores = rows.groupBy("core").agg(F.count("*").alias("times"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("times > 1")
    # written apart, so that the counts' shuffle is gone before the rows move
    cores = write_table(cores.select("core", (F.col("w0") == F.col("w1")).alias("same")), f"{label}-cores", compression="zstd")
    again = write_table(rows.join(cores, "core"), label, compression="zstd")
    drop_table(cores)
    mixed = again.where("not same").select("rid", "lo", "n", "pad", "core", "whole")
    extents = mixed.groupBy("core", "whole").agg(F.count("*").alias("times"), F.min(F.struct("rid", "lo")).alias("head"))
    told = mixed.join(extents, ["core", "whole"])
    run = ["rid", "lo", "n", "pad"]
    whole = again.where("same").select(run).unionByName(told.where("times > 1").select(run))
    every = whole.withColumn("fine", F.lit(False)).unionByName(told.where("head.rid = rid and head.lo = lo").select(run).withColumn("fine", F.lit(True)))
    parts = every.groupBy("rid").agg(F.collect_list(F.when(~F.col("fine"), F.struct("lo", "n"))).alias("hits"), F.collect_list(F.when(F.col("fine"), F.struct("lo", "n", "pad"))).alias("open"))
    out = write_table(parts, f"{label}-told", compression="zstd")
    drop_table(again)
    return out


def _runs(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The fields (lo, n and maybe a third) of each list of runs, an array each."""
    sizes = np.array([k or 0 for k in pc.list_value_length(column).to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    fields = [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in column.flatten().flatten()]
    for end, size in zip(ends, sizes):
        yield [f[end - size : end] for f in fields]


def _shared_passages(rows: DataFrame) -> DataFrame:
    """(rid, told, ask) of segments (rid, lo, n, core, whole) of passages: those that two documents have, and those whose windows must be listed.

    Of an extent that two documents have one representative is listed, marked ``many``, so that others find its windows."""
    cores = rows.groupBy("core").agg(F.min("rid").alias("r0"), F.max("rid").alias("r1"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("r0 != r1")
    cores = write_table(cores.select("core", (F.col("w0") == F.col("w1")).alias("same")), "passage-cores", compression="zstd")
    again = write_table(rows.join(cores, "core"), "passages", compression="zstd")
    drop_table(cores)
    mixed = again.where("not same").select("rid", "lo", "n", "core", "whole")
    extents = mixed.groupBy("core", "whole").agg((F.min("rid") != F.max("rid")).alias("many"), F.min(F.struct("rid", "lo")).alias("head"))
    each = mixed.join(extents, ["core", "whole"]).select("rid", "lo", "n", "many", (~F.col("many") | (F.col("head.rid") == F.col("rid")) & (F.col("head.lo") == F.col("lo"))).alias("ask"))
    every = again.where("same").select("rid", "lo", "n", F.lit(True).alias("many"), F.lit(False).alias("ask")).unionByName(each)
    parts = every.groupBy("rid").agg(F.collect_list(F.when(F.col("many"), F.struct("lo", "n"))).alias("told"), F.collect_list(F.when(F.col("ask"), F.struct("lo", "n", "many"))).alias("ask"))
    out = write_table(parts, "passages-told", compression="zstd")
    drop_table(again)
    return out


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, carry: list[str] | None = None) -> DataFrame:
    """One row per document: row, n_bytes, spans (array of [start, end) in bytes, removed), kept_sha256 (of the bytes left), n_shared_words."""
    source = docs.select(
        F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("body")
    )
    base = write_table(source.withColumn("rid", F.monotonically_increasing_id()), "texts", compression="zstd")
    parsed = T.StructType([T.StructField("rid", T.LongType()), T.StructField("lo", _INTS), T.StructField("n", _INTS), T.StructField("pad", _INTS), T.StructField("core", _LONGS), T.StructField("whole", _LONGS)])
    both = T.StructType([*parsed, *(T.StructField(f"word_{c}", k) for c, k in (("lo", _INTS), ("n", _INTS), ("core", _LONGS), ("whole", _LONGS)))])
    kinds = [pa.int32()] * 3 + [pa.int64()] * 2

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = zip(*((*segments(text, length), *passages(text)) for text in (t.as_py() for t in b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(_lists(c, k) for c, k in zip(found, [*kinds, *kinds[1:]]))], names=both.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = zip(*(blocks(t.as_py(), *runs, length) for t, runs in zip(b.column(1), _runs(b.column(2)))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(_lists(c, k) for c, k in zip(found, kinds))], names=parsed.names)

    def flat(df: DataFrame) -> DataFrame:
        return df.select("rid", F.explode(F.arrays_zip("lo", "n", "pad", "core", "whole")).alias("s")).select("rid", "s.*")

    texts = base.select("rid", "body")
    parse_table = write_table(texts.mapInArrow(parse, both), "parse", compression="zstd")
    first = _settled(flat(parse_table), "segments")
    words = parse_table.select("rid", F.explode(F.arrays_zip(*(F.col(f"word_{c}").alias(c) for c in ("lo", "n", "core", "whole")))).alias("s"))
    shared = _shared_passages(words.select("rid", "s.*"))
    drop_table(parse_table)
    open_ = first.where("size(open) > 0").select("rid", "open")
    block_table = write_table(texts.join(open_, "rid").select("rid", "body", "open").mapInArrow(cut, parsed), "blocks", compression="zstd")
    second = _settled(flat(block_table), "fine")
    drop_table(block_table)

    listed = T.StructType([
        T.StructField("rid", T.LongType()), T.StructField("x", _INTS), T.StructField("a", _LONGS), T.StructField("b", _LONGS),
        T.StructField("word_x", _INTS), T.StructField("word_a", _LONGS), T.StructField("word_b", _LONGS), T.StructField("many", T.ArrayType(T.BooleanType())),
    ])
    listed_kinds = [pa.int32(), pa.int64(), pa.int64()] * 2 + [pa.bool_()]

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows = zip((t.as_py() for t in b.column(1)), _runs(b.column(2)), _runs(b.column(3)))
            found = zip(*((*window_hashes(text, *runs[:2], length), *passage_hashes(text, *ask)) for text, runs, ask in rows))
            yield pa.RecordBatch.from_arrays([b.column(0), *(_lists(c, k) for c, k in zip(found, listed_kinds))], names=listed.names)

    open_ = second.where("size(open) > 0").select("rid", "open").join(shared.where("size(ask) > 0").select("rid", "ask"), "rid", "full")
    windows = write_table(texts.join(open_, "rid").select("rid", "body", "open", "ask").mapInArrow(list_windows, listed), "windows", compression="zstd")
    single = windows.select("rid", F.explode(F.arrays_zip("x", "a", "b")).alias("s")).select("rid", "s.*")
    twice = single.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1").select("a", "b")
    third = write_table(single.join(twice, ["a", "b"]).groupBy("rid").agg(F.collect_list(F.struct(F.col("x").alias("lo"), F.lit(1).alias("n"))).alias("hits")), "hits")
    single = windows.select("rid", F.explode(F.arrays_zip(F.col("word_x").alias("x"), F.col("word_a").alias("a"), F.col("word_b").alias("b"), "many")).alias("s")).select("rid", "s.*")
    twice = single.groupBy("a", "b").agg(F.min("rid").alias("r0"), F.max("rid").alias("r1"), F.max("many").alias("known")).where("known or r0 != r1").select("a", "b")
    more = write_table(single.where("not many").join(twice, ["a", "b"]).groupBy("rid").agg(F.collect_list(F.struct(F.col("x").alias("lo"), F.lit(1).alias("n"))).alias("told")), "told")
    drop_table(windows)

    none = F.lit(None).cast(third.schema["hits"].dataType)
    hits = [t.select("rid", "hits", none.alias("told")) for t in (first, second, third)] + [t.select("rid", none.alias("hits"), "told") for t in (shared, more)]
    hits = reduce(DataFrame.unionByName, hits).where("size(hits) > 0 or size(told) > 0")
    hits = write_table(hits.groupBy("rid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "told"))), "all-hits", compression="zstd")
    row = source.schema["row"]
    out = T.StructType([row, T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(_INTS)), T.StructField("kept_sha256", T.StringType()), T.StructField("n_shared_words", T.LongType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sizes, spans, shas, shared_words = [], [], [], []
            for text, (lo, n), told in zip((t.as_py() for t in b.column(1)), _runs(b.column(2)), _runs(b.column(3))):
                s = covered(lo, n, length)
                sizes.append(len(text))
                spans.append([list(x) for x in s])
                shas.append(_kept_sha(text, s))
                shared_words.append(sum(y - x for x, y in covered(*told, PASSAGE)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(_I32)), pa.array(shas, pa.string()), pa.array(shared_words, pa.int64())], names=out.names)

    told = base.join(hits, "rid", "left").select("row", "body", "hits", "told")
    return told.mapInArrow(finish, out)
