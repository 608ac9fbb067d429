"""Personal data by base patterns and a skip-chain conditional random field.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches with their checks. Tokens with a digit or an
at sign are the nodes of a field with labels none, email, ip, card, phone: unary potentials from a softmax over shape
and context features, chain potentials between neighbouring nodes, and skip potentials between a node and the last one
with the same key (equal text, or the same last seven digits) and the last similar one (equal but for one character in
each, by one-deletion variants), so that mentions agree across the document.
Base spans are evidence. Loopy sum-product message passing gives marginals; a node outside the base spans whose best
label is a kind with at least ``least`` probability becomes a span of that kind's ``crf_`` name.

The weights are learned here by pseudo-likelihood, unary, chain and skip potentials together and under the mask of labels
that inference uses, from a bounded sample of distinct documents (``train_docs``, by hash of the text, the first
``TRAIN_TOKENS`` tokens of each), with the base spans as labels; spans are then found in all documents and whole texts. Positions are code points, ends exclusive.

Defined results: null counts as empty and has no spans; repeated rows are searched one by one; without any training
token the field keeps its prior weights; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ["email", "ip", "card", "phone"]
KINDS = BASE + [f"crf_{k}" for k in BASE]
LABELS = 1 + len(BASE)
#: Bounds of the fitted sample: documents, and tokens of each.
TRAIN_DOCS, TRAIN_TOKENS = 2000, 300
#: Lengths of tokens that have similar ones.
SIMILAR_CHARS = (6, 40)
LEAST = 0.8
ROUNDS, DAMPING, EVIDENCE, SKIP_PRIOR = 12, 0.3, 12.0, 2.5
#: How strongly the pair potentials are held to their prior.
PULL = 0.1

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits fails or fits as a whole, so only its first digit can begin a match
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_CONTEXT = re.compile(r"(?i)\b(?:(e-?mails?|mail|contact)|(ip|host|server|address)|(card|visa|credit|pay\w*)|(phone|tel|call|mobile|fax|number))\W*$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            pos = m.end()
        at = text.find("@", max(at + 1, pos))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Nodes(NamedTuple):
    spans: list[tuple[int, int]]
    features: np.ndarray
    labels: np.ndarray  # of the base spans, 0 elsewhere
    keys: list[str]
    allowed: np.ndarray  # node x label


_EDGE = ".,;:!?\"'()[]{}<>"
FEATURES = 22


def _features(token: str, before: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    dots, dashes = token.count("."), token.count("-")
    m = _CONTEXT.search(before)
    context = [float(bool(m and m[k])) for k in (1, 2, 3, 4)]
    at, _, tail = token.partition("@")
    return [
        1.0, float(bool(at and tail)), float("@" in token and "." in tail), float(token[:1] == "+"), float("(" in token or ")" in token),
        float(letters == 0), float(letters > digits), float(digits <= 2), float(3 <= digits <= 6), float(7 <= digits <= 11), float(12 <= digits <= 19),
        float(digits > 19), float(dots == 3), float(dots == 1), float(dots > 3), float(dashes in (1, 2)), float(dashes > 2), float(digits == len(token)), *context,
    ]


def _allowed(token: str) -> list[bool]:
    """Which labels a token can have at all."""
    digits, letters = sum("0" <= c <= "9" for c in token), any(c.isalpha() for c in token)
    return [True, "@" in token, token.count(".") >= 3 and not letters, digits >= 4 and not letters, digits >= 4 and not letters]


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> Nodes:
    spans, features, labels, keys, allowed = [], [], [], [], []
    k = 0
    for m in _TOKEN.finditer(text):
        token = m[0].strip(_EDGE)
        if not token or not _HINT.search(token):
            continue
        start = m.start() + m[0].index(token)
        end = start + len(token)
        while k < len(base) and base[k][2] <= start:
            k += 1
        label, j = 0, k
        while not label and j < len(base) and base[j][0] < end:
            label = base[j][1] + 1 if base[j][2] > start else 0
            j += 1
        digits = re.sub("[^0-9]", "", token)
        spans.append((start, end))
        allowed.append(_allowed(token))
        features.append(_features(token, text[max(0, m.start() - 24) : m.start()]))
        labels.append(label)
        keys.append(digits[-7:] if len(digits) >= 7 and "@" not in token else token.lower())
    return Nodes(spans, np.array(features).reshape(-1, FEATURES), np.array(labels, dtype=np.int64), keys, np.array(allowed, dtype=bool).reshape(-1, LABELS))


class Field(NamedTuple):
    unary: np.ndarray  # FEATURES x LABELS
    chain: np.ndarray  # LABELS x LABELS
    skip: np.ndarray


def _edges(n: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring nodes (at most three characters apart), and of nodes with the same or a similar key (each with
    the first and the last one of its key, and with the last similar one)."""
    chain = [(i, i + 1) for i in range(len(n.spans) - 1) if n.spans[i + 1][0] - n.spans[i][1] <= 3]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    near: dict[str, int] = {}
    skip = []
    for i, key in enumerate(n.keys):
        if key in last:
            skip += [(j, i) for j in {first[key], last[key]}]
        if SIMILAR_CHARS[0] <= len(key) <= SIMILAR_CHARS[1]:
            variants = {key[:k] + key[k + 1 :] for k in range(len(key))} | {key}
            other = max((near[v] for v in variants if v in near), default=-1)
            if other >= 0 and n.keys[other] != key:
                skip.append((other, i))
            near.update(dict.fromkeys(variants, i))
        first.setdefault(key, i)
        last[key] = i
    return np.array(chain, dtype=np.int64).reshape(-1, 2), np.array(skip, dtype=np.int64).reshape(-1, 2)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(n: Nodes, field: Field) -> np.ndarray:
    """Label probabilities of each node by damped loopy message passing."""
    unary = n.features @ field.unary
    unary[~n.allowed] -= EVIDENCE
    known = np.flatnonzero(n.labels)
    unary[known, n.labels[known]] += 2 * EVIDENCE
    chain, skip = _edges(n)
    pairs = np.concatenate([chain, skip])
    if len(pairs):
        tables = np.concatenate([np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)])
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])  # (edge, from, to)
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        messages = np.zeros((len(src), LABELS))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, messages)
            out = _log_sum((belief[src] - messages[back])[:, :, None] + tables, 1)
            out -= _log_sum(out, 1)[:, None]
            messages = DAMPING * messages + (1 - DAMPING) * out
        np.add.at(unary, dst, messages)
    return np.exp(unary - _log_sum(unary, 1)[:, None])


def fit(samples: list[Nodes], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Potentials by gradient ascent of the pseudo-likelihood: each node's label given its neighbours' labels, among the labels it can have.

    Nodes without a base span whose key a base span shares are left out. The pair potentials are held to their prior (equal labels
    likelier at skips, none at the chain), the unary ones to zero."""
    unary, chain, prior = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS) * SKIP_PRIOR
    prior[0, 0] = 0.0
    skip = prior.copy()
    samples = [s for s in samples if len(s.labels)]
    if not samples:
        unary[0, 0] = 2.0
        return Field(unary, chain, skip)
    x, y = np.concatenate([s.features for s in samples]), np.concatenate([s.labels for s in samples])
    masked = np.where(np.concatenate([s.allowed for s in samples]), 0.0, -EVIDENCE)
    masked[np.arange(len(y)), y] = 0.0
    starts = np.cumsum([0] + [len(s.labels) for s in samples])
    pairs = [np.concatenate(p) for p in zip(*([e + at for e in _edges(s)] for s, at in zip(samples, starts)))]
    # a mention of what is labelled elsewhere in its document is no example of none: its label counts as not known
    hidden = np.zeros(len(y), dtype=bool)
    for a, b in ((0, 1), (1, 0)):
        hidden[pairs[1][:, a][y[pairs[1][:, b]] > 0]] = True
    hidden &= y == 0
    pairs = [e[~hidden[e].any(1)] for e in pairs]
    target = np.eye(LABELS)[y]
    for _ in range(rounds):
        score = x @ unary + masked
        for table, e in zip((chain, skip), pairs):
            np.add.at(score, e[:, 1], table[y[e[:, 0]]])
            np.add.at(score, e[:, 0], table.T[y[e[:, 1]]])
        gap = (target - np.exp(score - _log_sum(score, 1)[:, None])) / len(x)
        gap[hidden] = 0.0
        unary += rate * (x.T @ gap - decay * unary)
        for table, e, rest in zip((chain, skip), pairs, (0.0, prior)):
            g = np.zeros((LABELS, LABELS))
            np.add.at(g, y[e[:, 0]], gap[e[:, 1]])
            np.add.at(g.T, y[e[:, 1]], gap[e[:, 0]])
            table += rate * (g - PULL * (table - rest))
    return Field(unary, chain, skip)


def find_spans(text: str, field: Field, least: float = LEAST) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    if not _HINT.search(text):
        return [], []
    base = base_spans(text)
    n = nodes_of(text, base)
    if not len(n.labels) or n.labels.all():
        return base, base
    p = marginals(n, field)
    best = p.argmax(1)
    more = [(*n.spans[i][:1], len(BASE) + int(best[i]) - 1, n.spans[i][1]) for i in np.flatnonzero((n.labels == 0) & (best > 0) & (p.max(1) >= least))]
    return base, sorted(base + more)


def find_pii(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, train_docs: int = TRAIN_DOCS, least: float = LEAST) -> DataFrame:
    """One row per document: row, spans (array of (start, kind, end); kind is a place in KINDS), by start, then kind."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"), text.alias("text"))
    # hashes alone find the sample; then one text of each chosen hash is read
    hinted = base.where(F.rlike("text", F.lit("[0-9@]"))).select("text", F.xxhash64("text").alias("h"))
    chosen = hinted.select("h").distinct().orderBy("h").limit(train_docs).agg(F.max("h")).first()[0] if train_docs else None
    sample = hinted.where(F.col("h") <= F.lit(chosen)).groupBy("h").agg(F.min("text").alias("text")) if chosen is not None else hinted.limit(0)
    tokens = T.StructType([T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("features", T.ArrayType(T.DoubleType())),
                           T.StructField("labels", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("allowed", T.ArrayType(T.BooleanType()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [nodes_of(t, base_spans(t)) for t in b.column(0).to_pylist()]
            found = [Nodes(*(f[:TRAIN_TOKENS] for f in n)) for n in every]
            yield pa.RecordBatch.from_pydict(
                {"spans": [[list(s) for s in n.spans] for n in found], "features": [n.features.ravel().tolist() for n in found],
                 "labels": [n.labels.tolist() for n in found], "keys": [n.keys for n in found], "allowed": [n.allowed.ravel().tolist() for n in found]},
                schema=pa.schema([("spans", pa.list_(pa.list_(pa.int32()))), ("features", pa.list_(pa.float64())), ("labels", pa.list_(pa.int64())), ("keys", pa.list_(pa.string())), ("allowed", pa.list_(pa.bool_()))]),
            )

    rows = sample.select("text").mapInArrow(features, tokens).orderBy("keys", "labels").collect()  # train_docs x TRAIN_TOKENS small rows at most
    field = fit([Nodes([tuple(s) for s in r.spans], np.array(r.features).reshape(-1, FEATURES), np.array(r.labels, dtype=np.int64), r.keys, np.array(r.allowed, dtype=bool).reshape(-1, LABELS)) for r in rows])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out = T.StructType([base.schema["row"], T.StructField("spans", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": a, "kind": k, "end": z} for a, k, z in find_spans(t.as_py(), field, least)[1]] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, arrow_span)], names=["row", "spans"])

    return base.mapInArrow(run, out)
