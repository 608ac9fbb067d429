"""The near-duplicate stage against brute force over all pairs."""

import random

import corpus_pipeline as P
from weftgraph.llm import simhash_dedup


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute_kept(rows):
    sets = [brute_shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k].doc_id is None, rows[k].doc_id)):
        best.setdefault(find(k), rows[k])
    return sorted(map(str, best.values()))


def test_stage_keeps_no_similar_pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(P.STAGES)["near_dedup"]
    assert sorted(map(str, stage(spark, docs, sf_dir).collect())) == brute_kept(docs.collect())
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_large_groups_and_edges_of_the_threshold(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    base, common = [word() for _ in range(120)], [word() for _ in range(30)]
    texts = [None, "", " \t", "a b", "A  b", "a b c", "one two three four five", "one two three four six"]
    texts += [" ".join(base[:k]) for k in range(70, 121, 3)]
    for _ in range(150):  # copies that differ in 0 to 6 words
        t = list(base)
        for _ in range(rng.randrange(7)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(common + [word() for _ in range(rng.randrange(3, 60))]) for _ in range(80)]
    rng.shuffle(texts)
    rows = [(k if k % 9 else None, t, k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid int")
    got, rows = simhash_dedup.keep_first(docs).collect(), docs.collect()
    known = [str(r) for r in brute_kept([r for r in rows if r.doc_id is not None])]
    assert len(got) == len(brute_kept(rows))
    kept = simhash_dedup.keep_first(docs.where("doc_id is not null")).collect()
    assert sorted(map(str, kept)) == known
