"""Toxicity scores after noisy-channel deobfuscation.

Suspicious surfaces (letters mixed with digits or symbols, doubled letters and longer runs, single characters spelled
out with separators) span a lattice: each character may be itself, a letter that it stands for or a repetition, and a
separator may stand within a word or between two. Viterbi decoding under a character trigram model picks the likeliest
words, in time linear in the length of the surface; the model's counts come from the words of
all documents. The restored text is then scored by a logistic model over a lexicon: at most ``lexicon`` words and
beginnings of words whose presence goes with the label, with weights of at least zero, from a bounded sample of the
labelled documents (``fit_rows``, by hash of the id). A word counts by its presence, a beginning by its share of the
distinct tokens, so that other forms of a word count, too, and long texts gather no chance hits. Whole texts are scored;
only the text column goes to the Python workers.

Defined results: null counts as empty; empty texts get the model's base rate; labels are matched by id, repeated labels
of an id count as toxic if any is; without labels every score is the prior 0.1; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Collection, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.storage import write_table

#: Letters that the model knows: two ASCII cases are one, Latin-1 letters follow. Others share one symbol.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
EDGE, OTHER = "^", "?"
#: What a character may stand for, besides itself (fixed values).
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs (negative logs) of the channel: a symbol standing for a letter, a letter repeated, punctuation that is no letter,
#: a symbol left as it is.
SUBSTITUTE, REPEAT, DROP, KEEP_SYMBOL = 0.7, 0.4, 1.5, 12.0
PUNCTUATION = "!|+(@$"
SEPARATORS = " .*_-"
#: Costs of a separator, and of two or more in a row: within a word, between words.
WITHIN, BETWEEN = (0.0, 3.0), (1.0, 0.0)
#: Marks around a word that stand for no letter.
MARKS = ".,;:?'\"”“’‘…)[]{}<>-–—*_"
FIT_ROWS, LEXICON, LEAST_DOCS = 30_000, 3000, 3
#: Lengths of the beginnings of words that are features besides the words themselves.
BEGINNINGS = (3, 4, 5, 7)
#: Mark of a beginning; no word holds it.
OPEN = "-"
#: A beginning counts in full if one distinct token in so many has it; tokens that every text has besides its own.
FULL_SHARE, MORE_TOKENS = 60.0, 40
CACHE_WORDS = 100_000
#: Longest surface that is cached; longer ones are decoded each time.
CACHE_CHARS = 80
#: Characters whose trigrams are counted at once.
BLOCK_CHARS = 1 << 18

_SIGNS = re.escape("".join(STANDS_FOR))
_LETTER = r"[^\W\d_]"
#: letters and stand-ins mixed; a letter three times, or twice, in a row; single characters spelled out
_MIXED = re.compile(rf"(?:{_LETTER}|[{_SIGNS}*_])*(?:{_LETTER}[{_SIGNS}]+|[{_SIGNS}]+{_LETTER})(?:{_LETTER}|[{_SIGNS}*_])*")
_RUN = re.compile(rf"({_LETTER})\1\1")
_TWICE = re.compile(rf"({_LETTER})\1")
_SPELLED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{_SIGNS}])(?:(?:[ .*_-]{{1,2}})(?:[^\W_]|[{_SIGNS}])(?![^\W_]))+")
_WORD = re.compile(rf"{_LETTER}+")
_DOUBLE = re.compile(r"(.)\1+")
_SIGN = re.compile(rf"[{_SIGNS}]")


class CharModel(NamedTuple):
    """Trigram log probabilities over LETTERS, OTHER and EDGE, backed off to bigrams by interpolation."""

    logs: np.ndarray  # [first, second, third]
    index: dict[str, int]

    def at(self, c: str) -> int:
        return self.index.get(c, self.index[OTHER])


def char_model(counts: dict[int, int]) -> CharModel:
    """Model of the counts of trigrams, each given as one number like those of ``count_trigrams``."""
    symbols = LETTERS + OTHER + EDGE
    n = np.zeros(len(symbols) ** 3)
    n[list(counts)] = list(counts.values())
    n = n.reshape((len(symbols),) * 3)
    uni = n.sum((0, 1)) + 1.0
    bi = n.sum(0) + 5.0 * uni / uni.sum()
    bi /= bi.sum(1, keepdims=True)
    tri = (n + 5.0 * bi[None]) / (n.sum(2, keepdims=True) + 5.0)
    return CharModel(np.log(tri), {c: k for k, c in enumerate(symbols)})


def _symbols() -> np.ndarray:
    """The symbol of every code point: its place among LETTERS, OTHER for other letters, EDGE for what is no letter."""
    other, edge = len(LETTERS), len(LETTERS) + 1
    table = np.full(0x110000, edge, np.int32)
    table[[k for k in range(0x110000) if unicodedata.category(chr(k))[0] == "L"]] = other
    table[[ord(c) for c in LETTERS]] = range(len(LETTERS))
    return table


_tables: list[np.ndarray] = []


def count_trigrams(texts: list[str]) -> np.ndarray:
    """How often each trigram of symbols (first, second, third as one number) stands in the words of the texts, edges included."""
    if not _tables:
        _tables.append(_symbols())
    edge, size = len(LETTERS) + 1, len(LETTERS) + 2
    points = np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    t = _tables[0][points]
    gap = t == edge
    t = t[~(gap & np.concatenate([[False], gap[:-1]]))]  # one edge between two words
    first, second, third = t[:-2], t[1:-1], t[2:]
    # behind the edge before a word stands another one
    lead = np.bincount(t[1:2] + (edge * size + edge) * size, minlength=size**3) if len(t) > 2 else np.zeros(size**3, np.int64)
    return lead + np.bincount((np.where(second == edge, edge, first) * size + second) * size + third, minlength=size**3)


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): letter trigrams of the words of all documents, edges included; at most (len(LETTERS) + 2) ** 3 rows.

    Each task counts the trigrams of its own texts, block by block; only its counts are shuffled."""
    schema = T.StructType([T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LETTERS) + 2) ** 3, np.int64)
        for b in batches:
            block, chars = [], 0
            for t in b.column(0):
                block.append(t.as_py())
                chars += len(block[-1])
                if chars >= BLOCK_CHARS:
                    total += count_trigrams(block)
                    block, chars = [], 0
            total += count_trigrams(block)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    texts = docs.select(docs[text_col].alias("t")).where("t is not null")
    return texts.mapInArrow(run, schema).groupBy("gram").agg(F.sum("n").alias("n"))


def decode(surface: str, model: CharModel) -> str:
    """The likeliest words behind a surface: Viterbi over (last two letters); a repeated letter may be one, a separator nothing or a word's end."""
    logs, at = model.logs, model.at
    edge = model.index[EDGE]
    start = (edge, edge, "")
    # each state has its cost and its text, the latter as (text before, character)
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {start: (0.0, None)}
    gap = 0
    for c in surface.lower():
        if c in SEPARATORS:
            gap += 1
            continue
        if gap:
            wide = gap > 1
            ends = [(cost - logs[a, b, edge] + BETWEEN[wide], text) for (a, b, _), (cost, text) in states.items() if b != edge]
            states = {k: (cost + WITHIN[wide] * (k != start), text) for k, (cost, text) in states.items()}
            if ends:
                cost, text = min(ends, key=lambda e: e[0])
                if start not in states or cost < states[start][0]:
                    states[start] = cost, (text, " ")
            gap = 0
        options = [(x, SUBSTITUTE) for x in STANDS_FOR.get(c, "")]
        options.append((c, 0.0 if c.isalpha() else KEEP_SYMBOL))
        nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {k: (cost + DROP, w) for k, (cost, w) in states.items()} if c in PUNCTUATION else {}
        for (a, b, last), (cost, word) in states.items():
            for x, price in options:
                k = at(x)
                steps = [((b, k, x), cost + price - logs[a, b, k], (word, x))]
                if x == last:
                    steps.append(((a, b, x), cost + price + REPEAT, word))
                for key, total, text in steps:
                    if key not in nxt or total < nxt[key][0]:
                        nxt[key] = (total, text)
        states = nxt
    node = min(((cost - logs[a, b, edge], text) for (a, b, _), (cost, text) in states.items()), key=lambda e: e[0])[1]
    out: list[str] = []
    while node is not None:
        node, x = node
        out.append(x)
    return "".join(reversed(out))


def single(word: str) -> str:
    return _DOUBLE.sub(r"\1", word)


def forms(words: Collection[str]) -> set[str]:
    """The words and their beginnings, the latter marked."""
    return {*words, *(w[:k] + OPEN for w in words for k in BEGINNINGS if len(w) > k)}


class Restorer:
    """Restored words of texts, with bounded caches of decoded surfaces and of the features of tokens."""

    def __init__(self, model: CharModel, known: Collection[str] | None = None):
        """known: the only features that ``features`` is to return."""
        self.model, self.known, self.cache, self.tokens = model, known, {}, {}
        # words that are sought inside spelled-out passages, whose word ends the model may miss
        self.inner = {w for w in known or () if len(w) > 3 and not w.endswith(OPEN)}
        self.longest = max(map(len, self.inner), default=0)
        # how every known feature begins, as it stands and with doubled letters made one: other words need no look
        self.heads = None if known is None else {f[:3] for f in known}
        self.singles = None if known is None else {single(f)[:2] for f in known}

    def surface(self, s: str) -> str:
        found = self.cache.get(s)
        if found is None:
            found = decode(s, self.model)
            if len(s) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[s] = found
        return found

    def spelled(self, s: str) -> str:
        """A spelled-out passage decoded, with spaces around the known words that it holds (leftmost, longest first)."""
        text = self.surface(s)
        if not self.inner:
            return text
        letters, out, at, since = text.replace(" ", ""), [], 0, 0
        while at < len(letters):
            end = next((e for e in range(min(len(letters), at + self.longest), at + 3, -1) if letters[at:e] in self.inner), 0)
            if end:
                out += [letters[since:at], letters[at:end]]
                since = end
            at = end or at + 1
        return " ".join(w for w in [*out, letters[since:]] if w) if out else text

    def _wanted(self, plain: set[str], surfaces: list[str], passages: list[str] = ()) -> tuple[str, ...]:
        restored = {w for s in surfaces for w in _WORD.findall(self.surface(s))} - plain
        restored |= {w for s in passages for w in _WORD.findall(self.spelled(s))}
        return self._known(plain | restored | set(map(single, restored)))

    def _known(self, words: set[str]) -> tuple[str, ...]:
        every = forms(words)
        return tuple(every if self.known is None else every & self.known)

    def token(self, token: str) -> tuple[str, ...]:
        """Features of a token without white space, as it stands and restored."""
        core = token.strip(MARKS)
        if core.isalpha() and not _TWICE.search(core):  # one plain word
            found = self._known({core}) if self.heads is None or core[:3] in self.heads else ()
        else:
            plain = set(_WORD.findall(token))
            # letters alone decode to themselves but for doubled ones
            surfaces = [w for w in plain if _TWICE.search(w) and (self.singles is None or single(w)[:2] in self.singles)]
            if _SIGN.search(token):
                surfaces += [m[0] for m in _MIXED.finditer(token)]
            found = self._wanted(plain, surfaces)
        if len(token) <= 40:
            if len(self.tokens) >= CACHE_WORDS:
                self.tokens.clear()
            self.tokens[token] = found
        return found

    def words(self, text: str) -> set[str]:
        """Distinct words of the text itself and of its restored surfaces, the latter also with doubled letters made one."""
        return {w for w in self.features(text) if not w.endswith(OPEN)}

    def features(self, text: str) -> dict[str, float]:
        """Those words with 1, and their beginnings with their share of the distinct tokens, 1 at most.

        Mixed surfaces and runs of letters lie within tokens, so each distinct token is looked at once; spelled-out words,
        which cross tokens, are sought in the whole text."""
        low, n, get = text.lower(), Counter(), self.tokens.get
        tokens = set(low.split())
        for t in tokens:
            found = get(t)
            if found is None:
                found = self.token(t)
            for f in found:
                n[f] += 1
        spelled = [m[0] for m in _SPELLED.finditer(low)]
        if spelled:
            n.update(self._wanted(set(), [], spelled))
        share = FULL_SHARE / (len(tokens) + MORE_TOKENS)
        return {f: min(1.0, k * share) if f.endswith(OPEN) else 1.0 for f, k in n.items()}

    def restore(self, text: str) -> str:
        """The lower-cased text with its suspicious surfaces decoded."""
        text = _SPELLED.sub(lambda m: self.spelled(m[0]), text.lower())
        text = _MIXED.sub(lambda m: self.surface(m[0]), text)
        return _WORD.sub(lambda m: self.surface(m[0]) if _RUN.search(m[0]) else m[0], text)


_restorers: dict[int, tuple[object, Restorer]] = {}


def _restorer(shared) -> Restorer:
    """The worker's restorer for the broadcast (model, known words); it outlives tasks, so its caches do too."""
    value = shared.value
    if id(value) not in _restorers:
        _restorers.clear()
        _restorers[id(value)] = value, Restorer(*value)
    return _restorers[id(value)][1]


def fold(id_col: Column) -> Column:
    """Remainder of crc32 of the id as text by 5; 0 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


class Model(NamedTuple):
    chars: CharModel
    weights: dict[str, float]
    bias: float


def _lexicon(found: DataFrame, labels_total: tuple[int, int], size: int) -> list[str]:
    """Features that go with label 1, by signed log-likelihood ratio over all training documents."""
    pos, neg = labels_total
    n = float(pos + neg)
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")

    def part(seen: Column, row: Column, column: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(F.lit(0.0))

    row, rest = a + b, n - (a + b)
    g = part(a, row, float(pos)) + part(b, row, float(neg)) + part(F.lit(float(pos)) - a, rest, float(pos)) + part(F.lit(float(neg)) - b, rest, float(neg))
    ranked = write_table(found.where((F.col("pos") >= LEAST_DOCS) & (a * neg > b * pos)).select("w", g.alias("g")), "candidates")
    # among so many candidates, chance makes none of that ratio
    least = math.log(max(1, ranked.count()))
    return [r.w for r in ranked.where(F.col("g") >= least).orderBy(F.desc("g"), "w").limit(size).collect()]


def _fit(rows: list[tuple[list[int], list[float], int]], size: int, rounds: int = 400, decay: float = 0.01) -> tuple[np.ndarray, float]:
    """Sparse logistic regression, L2 and positive weights, by gradient steps; each row has its features, their values and its label."""
    y = np.array([t for *_, t in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(w) for w, *_ in rows])
    word = np.array([k for w, *_ in rows for k in w], dtype=np.int64)
    x = np.array([v for _, vs, _ in rows for v in vs], dtype=float)
    weights, bias = np.zeros(size), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    seen, speed, pull = np.bincount(word, x * x, minlength=size) + 4.0, np.zeros(size), 0.0
    for _ in range(rounds):
        score = bias + np.bincount(doc, weights[word] * x, minlength=len(rows))
        gap = y - 1 / (1 + np.exp(-score))
        step = np.bincount(word, gap[doc] * x, minlength=size) - decay * weights
        speed = 0.9 * speed + step / seen / 4
        pull = 0.9 * pull + 0.3 * gap.mean()
        weights, bias = np.maximum(weights + speed, 0.0), bias + pull
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", fit_rows: int = FIT_ROWS, lexicon: int = LEXICON) -> Model:
    """Char model of all documents; lexicon and weights from at most ``fit_rows`` labelled documents whose fold is not 0."""
    grams = trigram_counts(docs, text_col).collect()  # bounded by the alphabet
    chars = char_model({r.gram: r.n for r in grams})
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((chars, None))
    marks = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    sample = marks.where(fold(F.col("k")) != 0).orderBy(F.xxhash64("k"), "k").limit(fit_rows)
    source = docs.select(docs[id_col].alias("k"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    marked = source.join(F.broadcast(sample), "k").select(F.xxhash64("t").alias("h"), "t", "y")  # fit_rows narrow rows; the texts stay where they are
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("words", T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("x", T.FloatType())])))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _restorer(shared)
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                every = [restorer.features(t.as_py()) for t in b.column(1)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in every])]), pa.int32())
                flat = [pa.array([w for f in every for w in f], pa.string()), pa.array([x for f in every for x in f.values()], pa.float32())]
                words = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, ["w", "x"]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), words], names=["h", "y", "words"])

    # copies of a text count once
    every = marked.mapInArrow(split, schema)
    found = write_table(every.groupBy("h").agg(F.max("y").alias("y"), F.first("words").alias("words")), "restored")
    totals = {r.y: r["count"] for r in found.groupBy("y").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Model(chars, {}, math.log(1 / 9) if not pos + neg else math.log((pos + 1) / (neg + 1)))
    counts = found.select("y", F.explode("words.w").alias("w")).groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    names = _lexicon(counts, (pos, neg), lexicon)
    listed = spark.createDataFrame([(w, k) for k, w in enumerate(names)], "w string, k int")  # at most ``lexicon`` rows
    present = found.select("h", "y", F.explode("words").alias("e")).select("h", "y", "e.*").join(F.broadcast(listed), "w")
    present = present.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("fs"))
    every = found.select("h", "y").join(present, "h", "left").select("h", "y", F.coalesce("fs.k", F.array().cast("array<int>")).alias("ks"), F.coalesce("fs.x", F.array().cast("array<float>")).alias("xs"))
    rows = [(r.ks, r.xs, r.y) for r in every.orderBy("h").collect()]  # at most ``fit_rows`` lists of lexicon entries
    weights, bias = _fit(rows, len(names))
    return Model(chars, {w: float(x) for w, x in zip(names, weights) if x > 1e-3}, float(bias))


def score_text(text: str, restorer: Restorer, weights: dict[str, float], bias: float) -> float:
    total = sum(weights[w] * x for w, x in sorted(restorer.features(text).items()) if w in weights)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + total))))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: row, score, predicted (1 from 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.chars, frozenset(model.weights)))
    weights, bias = model.weights, model.bias

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer = _restorer(shared)
        for texts in batches:
            yield pa.array([score_text(t.as_py() or "", restorer, weights, bias) for t in texts], pa.float64())

    scored = docs.select(F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"), score(docs[text_col]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
