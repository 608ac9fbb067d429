"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier one is a broadcast table of frequent pre-tokens and their lengths in tokens: the vocabulary's own whole words, so
its size is bounded by the vocabulary (below 50,000 short strings). Tier two is a bounded cache in each Python worker
that encoding by the vocabulary's merges fills (the tokenizer library itself encodes
pre-tokens of more than 64 characters). Texts are split into pre-tokens by a pattern that is
exact for code points below U+0250. No pre-token spans white space, so in a text with other characters only the runs
between white space that hold one go to the library, through the same cache; a text with a special string of the
tokenizer goes to the library as a whole.

Defined results: null counts as empty, and empty texts have no tokens; repeated rows are counted one by one; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points for which the pattern below is exact: composed, lower-cased one by one.
PLAIN_END = 0x250
#: Pre-tokens that a worker remembers, and the longest one that it does.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Characters that are split at once; longer texts go match by match.
LONG_TEXT = 4_000_000


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c)).startswith(kind))


@lru_cache(1)
def pretoken_pattern() -> re.Pattern:
    letters, numbers, space = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


@lru_cache(4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def supports_pattern(path: str) -> bool:
    """Whether the tokenizer is of the kind that the pattern describes (word ends, lower case, the same split)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    return split in json.dumps(spec.get("pre_tokenizer")).replace("\\\\", "\\") and "Lowercase" in str(spec.get("normalizer"))


def frequent_lengths(path: str) -> dict[str, int]:
    """Lengths of the vocabulary's whole words; the first tier."""
    tok = load_tokenizer(path)
    whole = pretoken_pattern()
    words = {w[: -len("</w>")] for w in tok.get_vocab() if w.endswith("</w>")}
    words = sorted(w for w in words if w.isascii() and whole.fullmatch(w) and w == w.lower())
    return dict(zip(words, (len(e.ids) for e in tok.encode_batch(words, add_special_tokens=False))))


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(4)
def merge_ranks(path: str) -> dict[tuple[str, str], int]:
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"].get("merges", [])
    return {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(merges)}


def merged_length(word: str, ranks: dict[tuple[str, str], int]) -> int:
    """Tokens of one pre-token: merge the pair of least rank, leftmost first, until no pair has a rank."""
    letters, last = byte_letters(), len(ranks)
    parts = [letters[b] for b in word.encode()]
    parts[-1] += "</w>"
    found = [ranks.get(p, last) for p in zip(parts, parts[1:])]
    while found:
        least = min(found)
        if least == last:
            break
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del found[at]
        if at:
            found[at - 1] = ranks.get((parts[at - 1], parts[at]), last)
        if at < len(found):
            found[at] = ranks.get((parts[at], parts[at + 1]), last)
    return len(parts)


class Lengths(dict):
    """Pre-token to length: the first tier, then the worker's cache; a miss is encoded and remembered."""

    def __init__(self, first: dict[str, int], path: str):
        super().__init__(first)
        self.first, self.tok, self.ranks = first, load_tokenizer(path), merge_ranks(path)

    def encoded(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> int:
        if len(word) > CACHE_CHARS:
            return self.encoded(word)
        if len(self) - len(self.first) >= CACHE_WORDS:
            self.clear()
            self.update(self.first)
        n = self[word] = self.encoded(word) if not word.isascii() and _NOT_PLAIN.search(word) else merged_length(word, self.ranks)
        return n


@lru_cache(1)
def _special(path: str) -> re.Pattern | None:
    texts = [t.content for t in load_tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, texts))) if texts else None


_NOT_PLAIN = re.compile(f"[^\\x00-{chr(PLAIN_END - 1)}]")
_RUN = re.compile(r"[^ \t\r\n]+")


def count_plain(text: str, lengths: Lengths) -> int:
    text = text.lower()
    if len(text) > LONG_TEXT:
        return sum(lengths[m[0]] for m in pretoken_pattern().finditer(text))
    return sum(map(lengths.__getitem__, pretoken_pattern().findall(text)))


def count_text(text: str, lengths: Lengths, path: str, plain: bool = True) -> int:
    special = _special(path)
    if not plain or (special and special.search(text)):
        return lengths.encoded(text)
    if text.isascii() or not _NOT_PLAIN.search(text):
        return count_plain(text, lengths)
    total, rest, held = 0, [], 0
    for m in _RUN.finditer(text):
        run = m[0]
        if not run.isascii() and _NOT_PLAIN.search(run):
            total += lengths[run]
            continue
        rest.append(run)
        held += len(run) + 1
        if held > LONG_TEXT:
            total, rest, held = total + count_plain(" ".join(rest), lengths), [], 0
    return total + count_plain(" ".join(rest), lengths)


_workers: dict[str, Lengths] = {}


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: row (the carried columns), n_bytes, n_tokens."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"), text.alias("text"))
    first = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))
    plain = supports_pattern(path)
    out = T.StructType([base.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = Lengths(first.value, path)
        lengths = _workers[path]
        for b in batches:
            sizes, counts = [], []
            for t in b.column(1):
                s = t.as_py()
                sizes.append(len(s) if s.isascii() else len(s.encode()))
                counts.append(count_text(s, lengths, path, plain))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["row", "n_bytes", "n_tokens"])

    return base.mapInArrow(run, out)
