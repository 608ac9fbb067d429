"""Repeated substrings against brute force; toxicity on held-out labels and on disguised words."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import queries, suffix_dedup, toxicity


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((len(b), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def made(rng, length):
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage, other = fresh(length // 3), fresh(length // 2)
    texts = [None, "", "short", "a" * (3 * length), "ab" * length, "x" * length, "x" * (length - 1), fresh(200), fresh(300)]
    texts += [fresh(rng.randint(0, 40)) + passage + fresh(rng.randint(0, 40)) for _ in range(6)]
    texts += [other, other, other[: length + 5] + "#" + other[length + 5 :], other[7:], passage + other + passage, passage * 3]
    edited = fresh(400)
    for _ in range(5):
        k = rng.randrange(len(edited))
        texts.append(edited[:k] + "Q" + edited[k + rng.randint(0, 3) :])
    cut = passage[: length // 2]
    return texts + [fresh(30) + cut + fresh(30) for _ in range(4)]


def test_repeated_spans_brute_force(spark, monkeypatch):
    for length, block, seed in ((60, 1 << 20, 1), (60, 97, 2), (400, 1 << 20, 3)):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        texts = made(random.Random(seed), length)
        docs = spark.createDataFrame([(k, t, 1, b"", "h") for k, t in enumerate(texts)], "doc_id long, text string, rid int, body binary, h string")
        got = suffix_dedup.repeated_spans(docs, length=length).orderBy("row.doc_id").collect()
        want = brute(texts, length)
        for r, w in zip(got, want):
            assert (r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) == w, (length, r.row.doc_id)
            text = (r.row.text or "").encode()
            assert hashlib.sha256(suffix_dedup.remove_spans(text, r.spans)).hexdigest() == r.kept_sha256
        assert len(got) == len(texts) and suffix_dedup.repeated_spans(docs.limit(0)).count() == 0


def brute_words(texts, passage):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for k, w in enumerate(words):
        for i in range(len(w) - passage + 1):
            seen.setdefault(tuple(w[i : i + passage]), set()).add(k)
    out = []
    for w in words:
        hit = [False] * len(w)
        for i in range(len(w) - passage + 1):
            if len(seen[tuple(w[i : i + passage])]) > 1:
                hit[i : i + passage] = [True] * passage
        out.append(sum(hit))
    return out


def test_passages_shared_by_documents(spark):
    rng = random.Random(5)
    fresh = lambda n: [rng.choice("abcdefgé") * rng.randint(1, 3) + rng.choice(["", "x", "yy"]) for _ in range(n)]
    line, other, common = fresh(51), fresh(70), fresh(6)
    assert len(" ".join(line).encode()) < 400
    docs = [fresh(20) + line + fresh(33) for _ in range(4)] + [fresh(70) + line[:50] + fresh(5), line[1:], line]  # inside a line, and one word short
    docs += [other + fresh(9) + other, fresh(60) + other[3:60], other + ["q"] + other, other, other]  # twice in one document, and in several
    alone = fresh(80)
    docs += [alone + fresh(7) + alone, common * 30, common[2:] + common * 11, ["z"] * 200, ["z"] * 51, ["z"] * 50, fresh(50), []]
    edited = fresh(400)
    for _ in range(6):
        k = rng.randrange(400)
        docs.append(edited[:k] + fresh(rng.randint(0, 2)) + edited[k + rng.randint(0, 3) :])
    texts = [None] + [(" " if k % 2 else " \n").join(d) for k, d in enumerate(docs)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("row.doc_id").collect()
    want = brute_words(texts, 51)
    assert [r.n_shared_words for r in got] == want
    assert want[1:8] == [51] * 4 + [0, 0, 51] and [(len(r.spans) > 0) for r in got[1:5]] == [False] * 4


def test_query_passages_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_shared_words for r in queries.op6_suffix_dedup(spark, sf_dir).collect()}
    assert [got[r.doc_id] for r in rows] == brute_words([r.text for r in rows], 51)


def test_segments_cover_every_window_once():
    rng = random.Random(9)
    for n in (399, 400, 401, 3000):
        text = "".join(rng.choice("ab cd") for _ in range(n)).encode()
        lo, k, pad, core, whole = suffix_dedup.segments(text, 400)
        starts = sorted(x for a, c in zip(lo, k) for x in range(a, a + c))
        assert starts == list(range(max(0, n - 399))) and len(core) == len(whole) == len(lo)


def test_op6_query_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op6_suffix_dedup(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    for r, (n, spans, sha) in zip(rows, brute([r.text for r in rows], 400)):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (n, sum(b - a for a, b in spans), len(spans), sha)


def test_decoding_under_the_model():
    words = ["idiot", "moron", "stupid", "worthless", "the", "there", "mother", "clown", "radio", "motor"]
    counts = 50 * toxicity.count_trigrams([" ".join(words)])
    r = toxicity.Restorer(toxicity.char_model(dict(enumerate(counts.tolist()))))
    for bad, good in {"1d10t": "idiot", "i d i o t": "idiot", "m.o.r.o.n": "moron", "stuuuupid": "stupid", "cl0wn": "clown", "m0r0n!": "moron"}.items():
        assert good in r.words(f"so {bad} there"), bad
    assert toxicity.single(next(iter(r.words("w0rthl3ss") - {"w", "rthl", "ss"}))) == toxicity.single("worthless")
    assert r.restore("The mother in 2023") == "the mother in 2023"


def test_trigram_counts(spark):
    texts = ["Où est-il? l'Été, 12 日本", "", "  a\tb ", "x", None, "aa  aa\n"]
    size, at = len(toxicity.LETTERS) + 2, {c: k for k, c in enumerate(toxicity.LETTERS + toxicity.OTHER + toxicity.EDGE)}
    want = Counter()
    for word in re.findall(r"[^\W\d_]+", " ".join(t or "" for t in texts).lower()):
        k = [at["^"]] * 2 + [at.get(c, at["?"]) for c in word] + [at["^"]]
        want.update((a * size + b) * size + c for a, b, c in zip(k, k[1:], k[2:]))
    got = toxicity.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {r.gram: r.n for r in got} == dict(want)
    assert not toxicity.count_trigrams([]).any() and not toxicity.count_trigrams(["", "..."]).any()


def test_held_out_accuracy_and_odd_input(spark):
    rng = random.Random(6)
    base = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows, labels = [], []
    for k in range(1500):
        words = [rng.choice(base) for _ in range(30)]
        bad = k % 7 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["grimble", "grimble", "snorkle"] if k % 5 else ["gr1mble", "s n o r k l e", "snooorkle"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows + [(None, "grimble"), (9000, None), (9001, ""), (0, rows[0][1])], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = toxicity.score_toxicity(docs.withColumn("score", F.lit("x")), model).select("row.doc_id", "score", "predicted").collect()
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth]
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0}
    empty = toxicity.train(docs.limit(0), marks.limit(0))
    assert toxicity.score_toxicity(docs.limit(0), empty).count() == 0 and abs(toxicity.score_toxicity(docs, empty).first().score - 0.1) < 1e-9
