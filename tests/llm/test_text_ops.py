"""Secret scans, PII, token counts and SentencePiece against brute force, libraries and round trips."""

import math
import random
import re
import string
import time
import struct

import public_tokenizers
from pyspark.sql import functions as F

from weftgraph.llm import pii, queries, secret_scan, sentencepiece_codec, token_counts

ODD = [None, "", " ", "\n\t", "é", "日本語 テキスト", "a" * 70, "x▁y", "it's we'LL I'M 'Sx", "<|endoftext|> end", "😀 ok", "İstanbul ß Σ", "tab\there  two   three "]
SCHEMA = "doc_id long, text string, ids string, row string, spans string"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "i", "r", None) for k, t in enumerate(texts)] + [(0, texts[0], None, None, None), (None, "null id", None, None, None)], SCHEMA)


def brute_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for k, (_, run, least) in enumerate(secret_scan.CLASSES):
        before = list(out)
        for m in re.finditer(run, text):
            s = m[0].replace("-", "+").replace("_", "/")
            ent = max(-sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) for w in (s[i : i + 20] for i in range(len(s) - 19)))
            mixed = re.search("[0-9]", s) and re.search("[A-Za-z]", s)
            if mixed and ent >= least and not any(re.search(p, m[0]) for p in secret_scan.ALLOW) and not any(a <= m.start() and b >= m.end() for a, _, b in before):
                out.append((m.start(), 3 + k, m.end()))
    return sorted(out)


def test_secrets_many_matches(spark):
    """A text with 100,000 matches, and one whose candidates cross chunks: work grows with the matches, not with their square."""
    rng = random.Random(8)
    runs = ["".join(rng.choices("0123456789abcdef", k=24)) for _ in range(100_000)]
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=30)) for _ in range(1500)]
    texts = [" ".join(runs), " é ".join(keys), "token=" + " token=".join(keys)]
    began = time.time()
    got = secret_scan.scan_secrets(docs_of(spark, texts)).select("row", "spans").collect()
    assert time.time() - began < 120
    for r in got:
        spans = [tuple(s) for s in r.spans]
        if r.row.text == texts[0]:
            assert [s for s in spans if s[1] == 2] == [(25 * i, 2, 25 * i + 24) for i in range(100_000)]
        else:
            assert spans == brute_spans(r.row.text)


def test_secrets_brute_force(spark, sf_dir):
    rng = random.Random(2)
    pool = ["token=token:abcdef", "Password : 'hunter22'", "api_key=abc", "APIKEY=\"a.b-c=d/e\"", "AKIA" + "A" * 15, "AKIAAKIA" + "Z9" * 8, "0" * 24, "f" * 23, "deadbeef" * 3, "é", "\n", " ", "secret = ", "ſecret=abcdefg", "tokEn:xxxxxxx"]
    pool += ["".join(rng.choices(string.ascii_letters + string.digits + "+/-_", k=rng.randint(18, 45))) for _ in range(40)]
    pool += ["123e4567-e89b-12d3-a456-426614174000", "0123456789abcdef0123", "2024/01/02/some/long/path/name", "".join(rng.choices("0123456789abcdef", k=22))]
    texts = [None, ""] + ["".join(rng.choice(pool) + rng.choice(["", " ", ",", "é"]) for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["key " * 20000 + "token=abcdef99"]
    docs = docs_of(spark, texts)
    got = secret_scan.scan_secrets(docs).select("row", "spans").collect()
    assert len(got) == docs.count() and any(s.kind >= 3 for r in got for s in r.spans)
    for r in got:
        assert [tuple(s) for s in r.spans] == brute_spans(r.row.text), r.row.text
    real = queries.op5_secret_scan(spark, sf_dir).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in real:
        want = brute_spans(text[r.doc_id])
        assert r.spans == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.n_hex == sum(k == 2 for _, k, _ in want)
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def test_window_entropy_equals_counting_each_window(spark):
    rng = random.Random(3)
    runs = ["".join(rng.choice(secret_scan.ALPHABET + "-_") for _ in range(rng.randint(20, 120))) for _ in range(200)]
    runs += ["a" * 50, "ab" * 30, "A1" * 10, "-+" * 12, "_/" * 11 + "=", "".join(rng.choice("0123456789abcdef") for _ in range(5000))]
    for window in (5, 20):
        got = spark.createDataFrame([(r,) for r in runs], "r string").select("r", secret_scan.window_entropy(F.col("r"), window).alias("e")).collect()
        for r in got:
            s = r.r.replace("-", "+").replace("_", "/")
            windows = {s[i : i + window] for i in range(len(s) - window + 1)}
            assert abs(r.e - max(-sum(w.count(c) / window * math.log2(w.count(c) / window) for c in set(w)) for w in windows)) < 1e-9, r.r


def test_token_counts_equal_library(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    every = ["".join(chr(c) for c in range(1, 0x250)), "".join(f"a{chr(c)}B {chr(c)}" for c in range(1, 0x260))]
    docs = docs_of(spark, ODD + every).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    got = token_counts.count_tokens(docs, path).collect()
    tok = token_counts.load_tokenizer(path)
    assert len(got) == docs.count()
    for r in got:
        text = r.row.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tok.encode(text, add_special_tokens=False).ids))
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_runs_beyond_the_plain_range_equal_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    lengths, tok = token_counts.Lengths(token_counts.frequent_lengths(path), path), token_counts.load_tokenizer(path)
    rng = random.Random(7)
    pool = ["the", "don't", "caf\u00e9", "e", "\u0301", "\u2019s", "\u201cquoted\u201d", "\u2014", "\u03a3\u03b1\u03a3", "\u043f\u0440\u0438\u0432\u0435\u0442", "\u6f22\u5b57", "\U0001f600", "12", "'S", "\u0130", "\u212a", "\u3000", "\u2003", "\u0085", "\x1c", "\x0b", "\xa0", "\ufb01", "\uac00", "\u1100\u1161", "x" * 70, "\u20ac" * 70, "<|endoftext|>"]
    texts = ["".join(rng.choice(pool) + rng.choice(["", " ", "  ", "\n", "\t", "\r\n"]) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [token_counts.count_text(t, lengths, path) for t in texts] == want
    monkeypatch.setattr(token_counts, "LONG_TEXT", 20)
    assert [token_counts.count_text(t, lengths, path) for t in texts] == want
    whole, encode = [], lengths.encoded
    monkeypatch.setattr(lengths, "encoded", lambda t: whole.append(t) or encode(t))
    token_counts.count_text("plain words and one \u20acuro", lengths, path)
    assert all(len(t) < 10 for t in whole)


def test_other_tokenizer_goes_to_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_counts.supports_pattern(path)
    tok = token_counts.load_tokenizer(path)
    got = token_counts.count_tokens(docs_of(spark, ODD), path).collect()
    assert all(r.n_tokens == len(tok.encode(r.row.text or "", add_special_tokens=False).ids) for r in got)


def unigram_model(path, scores):
    """The model file with these scores and of the unigram kind, for the library."""

    def varint(b, i):
        v = s = 0
        while True:
            v, s, i = v | (b[i] & 127) << s, s + 7, i + 1
            if b[i - 1] < 128:
                return v, i

    def enc(v):
        o = b""
        while v > 127:
            o, v = o + bytes([v & 127 | 128]), v >> 7
        return o + bytes([v])

    def fields(b):
        i = 0
        while i < len(b):
            tag, j = varint(b, i)
            end = {0: lambda: varint(b, j)[1], 1: lambda: j + 8, 2: lambda: sum(varint(b, j)), 5: lambda: j + 4}[tag & 7]()
            yield tag, b[i:end], b[varint(b, j)[1] : end] if tag & 7 == 2 else b""
            i = end

    with open(path, "rb") as f:
        raw, out, k = f.read(), b"", 0
    for tag, whole, body in fields(raw):
        if tag == 10:
            body = b"".join(w for t, w, _ in fields(body) if t != 21) + b"\x15" + struct.pack("<f", scores[k])
            k += 1
        elif tag == 18:
            body = b"".join(b"\x18\x01" if t == 24 else w for t, w, _ in fields(body))
        out += enc(tag) + enc(len(body)) + body if tag & 7 == 2 else whole
    return out


def test_sentencepiece_against_library_and_round_trip(spark, sf_dir):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece_codec.load_pieces(path)
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(path, pieces.scores))
    docs = docs_of(spark, ODD).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    encoded = sentencepiece_codec.encode_pieces(docs, path)
    got = encoded.collect()
    assert len(got) == docs.count()
    for r in got:
        text = r.row.text or ""
        assert r.round_trip == ("▁" not in text) and r.n_pieces == len(r.ids)
        want = library.encode(text)
        if want != r.ids:  # the library adds up 32-bit scores, so paths that are as good may differ
            total = lambda ids: sum(pieces.scores[i] for i in ids)
            assert abs(total(want) - total(r.ids)) < 0.01 and library.decode(r.ids) == text
    back = sentencepiece_codec.decode_pieces(encoded.select(F.col("row.text").alias("want"), "ids"), path).select("row.want", "text").collect()
    assert all(r.text == (r.want or "").replace("▁", " ") for r in back)
    assert sentencepiece_codec.encode_pieces(docs.limit(0), path).count() == 0


def brute_pii(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_base_spans_brute_force_and_field(spark, sf_dir):
    rng = random.Random(4)
    parts = ["@", ".", "a", "b.c", "-", "1", "22", "255", "256", "+", " ", "(", ")", "é", "4111111111111111", "4111 1111-1111 1111", "x@y.z", "1.2.3.4", "+1 (988) 555-2485", "007.1.1.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == brute_pii(t), t
    call = "call +1 (988) 555-2485 now, or 9885552485 later; 988-555-2485 too. Version 2.0. is out"
    docs = docs_of(spark, [*ODD, *texts[:200], call, "a" * 200000 + "1", "1" * 100000, "@" * 5000])
    docs = docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    got = pii.find_pii(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if len(r.row.text or "") < 50000:
            assert [tuple(s) for s in r.spans if s.kind < 4] == brute_pii(r.row.text)
    spans = next(r for r in got if r.row.text == call).spans
    assert {call[s.start : s.end] for s in spans if s.kind == 7} == {"9885552485", "988-555-2485"}
    assert pii.find_pii(docs.limit(0)).count() == 0 and pii.find_pii(docs.where("doc_id = 0")).count() > 0


def test_loopy_messages_equal_enumeration_on_a_tree():
    rng = __import__("numpy").random.default_rng(1)
    np = __import__("numpy")
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(5, 5)), np.zeros((5, 5)))
    n = pii.Nodes([(0, 2), (3, 5), (6, 8)], rng.normal(size=(3, pii.FEATURES)), np.zeros(3, np.int64), ["a", "b", "c"], np.ones((3, 5), bool))
    u = n.features @ field.unary
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2][None, None] + field.chain[:, :, None] + field.chain[None])
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]) / joint.sum()
    assert np.allclose(pii.marginals(n, field), want, atol=1e-3)
