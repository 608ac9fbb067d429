"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and their log scores come from a SentencePiece model file. A unigram model's scores are used as they are;
a BPE model only ranks its pieces, so their log scores follow the Zipf-Mandelbrot law of the rank. Spaces become the
marker U+2581 with one in front of the text; characters without a piece fall back to byte pieces. No piece has the
marker after another character (checked), so a text decomposes exactly at each space after a word, and the best path of
such a segment is remembered in a bounded cache of the worker.

Defined results: null counts as empty; an empty text has no pieces and decodes to an empty text; a text with a
literal U+2581 encodes like one with spaces (so it does not round-trip); repeated rows are encoded one by one; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Offset and exponent of the Zipf-Mandelbrot law for models that only rank their pieces.
ZIPF_OFFSET, ZIPF_POWER = 2.7, 1.0
#: What a character without a piece costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Segments in each half of a worker's cache, and the longest one that it keeps.
CACHE_SEGMENTS, CACHE_CHARS = 150_000, 64
_SEGMENT = re.compile(r" *[^ ]+| +")


class Pieces(NamedTuple):
    """A double-array trie over UTF-8 bytes (base, check, value) with the pieces' scores, texts and byte pieces."""

    base: list[int]
    check: list[int]
    value: list[int]
    scores: list[float]
    texts: list[bytes]
    bytes_: list[int]
    by_segment: bool
    longest: int  # bytes of the longest piece


def read_pieces(path: str) -> tuple[list[str], list[float], list[int], list[int]]:
    """(texts, log scores, ids that text can match, ids of the 256 byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    texts, scores = [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids]
    normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    own = np.array([scores[i] for i in normal])
    if len(own) and (own == np.rint(own)).all():
        logs = -ZIPF_POWER * np.log(-own + ZIPF_OFFSET)
        logs -= np.log(np.exp(logs).sum())
        for i, s in zip(normal, logs.tolist()):
            scores[i] = s
    return texts, scores, normal, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def build_trie(keys: list[tuple[bytes, int]]) -> list[list[int]]:
    """Double array of the keys: the child of state s for byte b is t = base[s] + b if check[t] == s; value[t] is the key's id or -1."""
    size, window = 1 << 16, 4096
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    check[0] = 0
    low, wide = 256, 256  # where the search for one free cell and for several begins; every label fits below
    ordered = sorted(keys)
    queue = [(0, 0, len(ordered), 0)]  # state, range of keys, depth
    for state, start, end, depth in queue:
        if start < end and len(ordered[start][0]) == depth:
            value[state] = ordered[start][1]
            start += 1
        if start == end:
            continue
        cuts = [start] + [i for i in range(start + 1, end) if ordered[i][0][depth] != ordered[i - 1][0][depth]] + [end]
        labels = [ordered[i][0][depth] for i in cuts[:-1]]
        if max(low, wide) + 2 * window + 512 >= size:
            base, check, value = (np.concatenate([x, np.full(size, f, np.int64)]) for x, f in ((base, 0), (check, -1), (value, -1)))
            size *= 2
        if len(labels) == 1:
            while check[low] != -1:
                low += 1
            at = low - labels[0]
        else:
            free = check[wide : wide + window + 256] == -1
            fits = np.logical_and.reduce([free[x : x + window] for x in labels])
            if not fits.any():
                wide += window
                at = wide
                while not (check[at + np.array(labels)] == -1).all():
                    at += 1
            else:
                at = wide + int(fits.argmax())
        base[state] = at
        check[at + np.array(labels)] = state
        queue.extend((at + x, a, z, depth + 1) for x, a, z in zip(labels, cuts, cuts[1:]))
    end = int(np.flatnonzero(check >= 0).max()) + 257  # so that no step leaves the arrays
    pad = max(0, end - size)
    return [np.concatenate([x, np.full(pad, f, np.int64)])[:end].tolist() for x, f in ((base, 0), (check, -1), (value, -1))]


def load_pieces(path: str) -> Pieces:
    texts, scores, normal, byte_ids = read_pieces(path)
    base, check, value = build_trie([(texts[i].encode(), i) for i in normal])
    raw = [t.replace(MARK, " ").encode() for t in texts]
    for b, i in enumerate(byte_ids):
        raw[i] = bytes([b])
    apart = not any(re.search(f"[^{MARK}]{MARK}", texts[i]) for i in normal)
    return Pieces(base, check, value, scores, raw, byte_ids, apart, max((len(texts[i].encode()) for i in normal), default=0))


def viterbi(segment: bytes, p: Pieces, unknown: float) -> list[int]:
    """Ids of the best path through the pieces of ``segment``; characters without a piece give their bytes' ids."""
    base, check, value, scores = p.base, p.check, p.value, p.scores
    n, none = len(segment), float("-inf")
    best, start, via = [none] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        if here == none:
            continue
        lead = segment[i]
        char_end = i + 1 if lead < 0x80 else i + 2 if lead < 0xE0 else i + 3 if lead < 0xF0 else i + 4
        state, end, known = 0, i, False
        for byte in segment[i : i + p.longest]:
            t = base[state] + byte
            if check[t] != state:
                break
            state = t
            end += 1
            v = value[t]
            if v >= 0:
                score = here + scores[v]
                if score > best[end]:
                    best[end], start[end], via[end] = score, i, v
                if end == char_end:
                    known = True
        if not known and here + unknown > best[char_end]:
            best[char_end], start[char_end], via[char_end] = here + unknown, i, -1
    out: list[int] = []
    at = n
    while at:
        i, v = start[at], via[at]
        out.extend([v] if v >= 0 else [p.bytes_[b] for b in reversed(segment[i:at])])
        at = i
    return out[::-1]


class Codec:
    """Encoder and decoder of one worker, with its cache of segments."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.unknown = min(pieces.scores[v] for v in pieces.value if v >= 0) - UNKNOWN_PENALTY
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _miss(self, segment: str) -> bytes:
        """From the older half of the cache, else by the trie; then it is in the younger half."""
        ids = self.older.get(segment) or array("i", viterbi(segment.replace(" ", MARK).encode(), self.p, self.unknown)).tobytes()
        if len(segment) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_SEGMENTS:
                self.older, self.cache = self.cache, {}
            self.cache[segment] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Piece ids of ``text`` as packed 32-bit integers."""
        if not text:
            return b""
        marked = " " + text.replace(MARK, " ")
        if not self.p.by_segment:
            return self._miss(marked)
        get, miss = self.cache.get, self._miss
        return b"".join([get(s) or miss(s) for s in _SEGMENT.findall(marked)])

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: markers become spaces, the first one goes; byte pieces are put together, broken ones replaced."""
        text = b"".join(map(self.p.texts.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def _codec(key: str, pieces) -> Codec:
    if key not in _codecs:
        _codecs[key] = Codec(pieces.value)
    return _codecs[key]


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: row, ids (array of int), n_pieces, n_bytes_pieces, round_trip (decoding gives the text back)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"), text.alias("text"))
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(path))  # bounded by the model's vocabulary
    long, names = T.LongType(), ["row", "ids", "n_pieces", "n_byte_pieces", "round_trip"]
    kinds = [base.schema["row"].dataType, T.ArrayType(T.IntegerType()), long, long, T.BooleanType()]
    out = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pieces)
        is_byte = np.zeros(len(codec.p.texts), dtype=bool)
        is_byte[[i for i in codec.p.bytes_ if i >= 0]] = True
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                packed, same = [], []
                for t in b.column(1):
                    s = t.as_py()
                    ids = codec.encode(s)
                    packed.append(ids)
                    same.append(codec.decode(np.frombuffer(ids, np.int32).tolist()) == s)
                values = np.frombuffer(b"".join(packed), np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])])
                fallback = np.concatenate([[0], np.cumsum(is_byte[values])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                n_byte = fallback[offsets[1:]] - fallback[offsets[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), lists, pa.array(np.diff(offsets), pa.int64()), pa.array(n_byte, pa.int64()), pa.array(same, pa.bool_())], names=names
                )

    return base.mapInArrow(run, out)


def decode_pieces(encoded: DataFrame, path: str, ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: row (the carried columns) and text; null ids decode to null."""
    base = encoded.select(F.struct(*[encoded[c] for c in (carry or encoded.columns)]).alias("row"), encoded[ids_col].alias("ids"))
    pieces = encoded.sparkSession.sparkContext.broadcast(load_pieces(path))
    out = T.StructType([base.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pieces)
        for b in batches:
            texts = [None if x.as_py() is None else codec.decode(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return base.mapInArrow(run, out)
