"""URL filters, exact dedup, SimHash and decontamination against brute force and on odd input."""

import itertools
import random
import re

import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, exact_dedup, queries, simhash_dedup, url_filter
from weftgraph.operators.components import connected_components

SCHEMA = "doc_id long, text string, chunks string, row string, u string"


def odd_docs(spark):
    rows = [
        (1, "a b c d e f", "x", None, None), (2, "a b c d e f", "y", "z", "q"), (2, "a b c d e f", "y", "z", "q"), (3, None, None, None, None),
        (4, "", None, None, None), (5, " \t\n", "c", "r", "u"), (None, "a b", None, None, None), (7, "one", None, None, None),
        (8, "wörd " * 30000, None, None, None), (9, "wörd " * 30000 + "x", None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.org/en/12?x", "https://example.org/es/1", "http://x.com/de/", "http://x.com/dex", None, "nohost", "http://com/fr/#f", "http://a.org", "http://é.COM/de/1"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(99, urls[0], "h")], "page_id long, url string, host string")
    rules = spark.createDataFrame(queries.RULES + [(None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    assert got[0] == got[99] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[1][2:] == ("example.org/es/", "block")
    assert got[2][2:] == ("com/de/", "block") and got[3][2:] == (None, "allow")
    assert got[4] == ("", "", None, "allow") == got[5]
    assert got[6][2:] == ("com/fr/", "allow") and got[7] == ("a.org", "", None, "allow") and got[8][3] == "block"
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).count() == len(urls) + 1


def brute_rule(url, rules):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(min(fits)[1:] if fits else (None, "allow")))


def test_url_rules_brute_force_when_prefixes_collide(spark, monkeypatch):
    rng = random.Random(4)
    hosts, paths = ["org", "x.org", "a.x.org", "com", "y.com", "org.com"], ["", "/", "/a", "/a/b", "/ab", "/b"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.7]
    # of equal length: x.org + /a and org + /a/b; the smaller text wins
    rules = [r for r in rules if r[:2] not in {("x.org", "/a"), ("org", "/a/b")}] + [("x.org", "/a", "allow"), ("org", "/a/b", "block")]
    urls = [f"http://{rng.choice(['', 'w.', 'A.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/b', 'b', '?q=/a', '#/b'])}" for _ in range(400)]
    urls += [None, "", "://", "http://", "x.org/a", "http://x.org/a/b", "http://" + "a." * 5000 + "x.org/a" + "/b" * 50000] + [None] * 50
    pages = spark.createDataFrame([(k, u, "k", "b") for k, u in enumerate(urls)], "page_id long, url string, key string, best string")
    sides = spark.createDataFrame(rules, "host string, path string, verdict string")
    for digits in (8, 1, 0):
        monkeypatch.setattr(url_filter, "PREFIX_HEX", digits)
        got = url_filter.filter_urls(pages, sides).select("row.page_id", "row.key", "host", "path", "rule", "verdict").collect()
        assert len(got) == len(urls) and {r.key for r in got} == {"k"}
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute_rule(urls[r.page_id], rules), urls[r.page_id]


def test_exact_groups(spark):
    docs = odd_docs(spark)
    out = exact_dedup.exact_groups(docs).select("row.doc_id", "row.chunks", "keep_id", "group_size", "kept").collect()
    assert len(out) == docs.count()
    by = {(r.doc_id, r.chunks): r for r in out}
    assert by[1, "x"].keep_id == 1 and by[1, "x"].group_size == 3 and by[1, "x"].kept
    assert by[5, "c"].keep_id == 5 and by[3, None].group_size == 3 and not by[3, None].kept
    assert by[8, None].keep_id == 8 and by[9, None].keep_id == 9
    assert sum(r.kept for r in out) == len({re.sub(r"[\x20\x09-\x0D]+", "", r.text or "") for r in docs.collect()})
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_groups_with_clashing_hashes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a ", "c"])], "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: real(c) * 0)
    got = {r.id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 3}


def brute_fingerprint(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(values), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprints_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).where("doc_id < 8").select("doc_id", "text"))
    got = simhash_dedup.near_groups(docs).select("row", "fp", "root", "component_id").collect()
    assert len(got) == docs.count()
    assert all(brute_fingerprint(r.row.text, 3) == r.fp % 2**64 for r in got)
    want = brute_components({r.fp for r in got})
    least = {}
    for r in got:
        least[want[r.fp]] = min(least.get(want[r.fp], 1 << 60), r.row.doc_id if r.row.doc_id is not None else 1 << 60)
    assert all(r.component_id == least[want[r.fp]] for r in got)


def test_links_in_dense_groups(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(4):  # clusters so dense that variants are shared by many, some linked only through two-bit steps
        centre = rng.getrandbits(64)
        for _ in range(120):
            v = centre
            for b in rng.sample(range(20), rng.randint(0, 4)):
                v ^= 1 << b
            values.add(v - (1 << 64) if v >> 63 else v)
    values |= {rng.getrandbits(63) for _ in range(50)}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash_dedup.near_links(fps)
    assert links.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) > 2).count() == 0
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_components(values)
    pairs = lambda m: {frozenset(x for x in values if m.get(x, x) == c) for c in {m.get(x, x) for x in values}}
    assert pairs(got) == pairs(want)


def test_near_groups_odd_and_keep_first(spark):
    docs = odd_docs(spark)
    groups = simhash_dedup.near_groups(docs).select("row.doc_id", "component_id").collect()
    assert {r.component_id for r in groups if r.doc_id in (3, 4, 5)} == {3}
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect())[:4] == ["1", "3", "7", "8"]
    assert simhash_dedup.keep_first(docs.limit(0)).count() == 0


def brute_hits(docs, items, n):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for _, t in docs:
        w, hit, ids = split(t), set(), set()
        for item, text in items:
            b = split(text)
            for i in range(max(len(b) - n + 1, 1 if b else 0)):
                g = b[i : i + n]
                for at in range(len(w) - len(g) + 1):
                    if w[at : at + len(g)] == g:
                        hit |= set(range(at, at + len(g)))
                        ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_decontamination_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "δέλτα", "É", "x1"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, text(k)) for i, k in enumerate([1, 2, 3, 4, 6, 9, 9])] + [(7, None), (8, "..."), (2, "x1 x1")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(40)] + [(90, None), (91, ""), (92, items[5][1] + ", " + items[5][1])]
    d = spark.createDataFrame([(a, b, "w") for a, b in docs], "doc_id long, text string, words string")
    for n in (4, 13):
        got = decontaminate.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), n).orderBy("row.doc_id").collect()
        assert [(r.n_words, r.n_hit, list(r.item_ids)) for r in got] == brute_hits(docs, items, n)
    empty = decontaminate.decontaminate(d, spark.createDataFrame([], "item_id long, text string")).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(empty) == (0, len(docs))
    assert decontaminate.decontaminate(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
