"""The decoder against all paths of its lattice; several words, long surfaces, doubled letters, short spelled words; the query."""

import random
import zlib

import numpy as np

from weftgraph.llm import queries, toxicity

WORDS = "you are a worthless pathetic disgusting idiot and liar stupid ass fool the there mother clown radio motor".split()


def restorer():
    counts = 50 * toxicity.count_trigrams([" ".join(WORDS)])
    return toxicity.Restorer(toxicity.char_model(dict(enumerate(counts.tolist()))))


def test_spelled_out_passages_keep_their_words():
    r = restorer()
    text = "you are a worthless pathetic disgusting idiot and a liar"
    wide = "  ".join(" ".join(w) for w in text.split())
    assert len(wide) > 80 and set(text.split()) - {"a"} <= r.words(wide)
    narrow = " ".join("".join(text.split()))
    assert len(narrow) > 80 and {"worthless", "pathetic", "idiot"} <= {toxicity.single(w) for w in r.words(narrow)} | r.words(narrow)
    assert {"stupid", "idiot"} <= r.words("so s t u p i d i d i o t there")
    assert {"stupid", "idiot"} <= r.words("so s t u p i d  1 d i 0 t there")


def test_long_surfaces_take_linear_time():
    r = restorer()
    long = "  ".join(" ".join(w) for w in ["idiot", "clown"] * 1500)
    assert {"idiot", "clown"} <= r.words(long) and not r.cache
    assert "idiot" in r.words("x1" * 50 + " 1d10t")


def test_doubled_letters_and_short_words():
    r = restorer()
    assert "idiot" in r.words("such an idiiot") and "stupid" in r.words("stuupid")
    assert "ass" in r.words("a s s") and "ass" in r.words("an a.s.s\nthere")


def all_paths(surface, model):
    """Least cost of every text that the lattice of a surface has."""
    t, edge, found = toxicity, model.index[toxicity.EDGE], {}
    word_cost = lambda w: -sum(model.logs[a, b, c] for a, b, c in zip([edge, edge, *w], [edge, *w, edge], [*w, edge]))
    chars = surface.lower()

    def walk(k, words, cost, gap):
        """``words``: finished ones and the open one, letters only; ``cost``: of the channel."""
        if k == len(chars):
            total = cost + sum(word_cost([model.at(c) for c in w]) for w in words)
            text = " ".join(words)
            found[text] = min(total, found.get(text, np.inf))
            return
        c, word = chars[k], words[-1]
        if c in t.SEPARATORS:
            return walk(k + 1, words, cost, gap + 1)
        if gap:
            if word:
                walk(k, [*words, ""], cost + t.BETWEEN[gap > 1], 0)
            return walk(k, words, cost + (t.WITHIN[gap > 1] if word else 0.0), 0)
        if c in t.PUNCTUATION:
            walk(k + 1, words, cost + t.DROP, 0)
        for x, price in [(x, t.SUBSTITUTE) for x in t.STANDS_FOR.get(c, "")] + [(c, 0.0 if c.isalpha() else t.KEEP_SYMBOL)]:
            walk(k + 1, [*words[:-1], word + x], cost + price, 0)
            if word and word[-1] == x:
                walk(k + 1, words, cost + price + t.REPEAT, 0)

    walk(0, [""], 0.0, 0)
    return found


def test_decoding_takes_the_cheapest_of_all_paths():
    rng, r = random.Random(8), restorer()
    surfaces = ["1d10t", "i d  1 o", "a s s", "a  1  $$", "f00!", "!!a!", "..a.b", "a", "..", "", "é1 日o", "st*p"]
    surfaces += ["".join(rng.choice("aasso01!$  .td") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    for s in surfaces:
        paths, got = all_paths(s, r.model), toxicity.decode(s, r.model)
        assert abs(paths[got] - min(paths.values())) < 1e-6, (s, got, min(paths, key=paths.get))


def test_query_never_sees_held_out_labels(spark, sf_dir, tmp_path):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf_dir).collect()}
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    rest = lambda k: zlib.crc32(str(k).encode()) % 5
    turned = [(r.doc_id, (1 - r.toxic) if r.toxic is not None and rest(r.doc_id) == 0 else r.toxic) for r in labels.select("doc_id", "toxic").collect()]
    docs.withColumn("lang", docs.source).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turned, labels.select("doc_id", "toxic").schema).write.parquet(f"{tmp_path}/labels.parquet")
    again = {r.doc_id: r for r in queries.op4_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == docs.count() and got.keys() == again.keys()
    for k, r in got.items():
        assert r.held_out == (rest(k) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert abs(r.score - again[k].score) < 1e-9
