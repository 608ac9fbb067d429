"""Conversation repair, source mixing and divergence audit against plain versions, and their defined cases."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import conversation_repair as cr
from weftgraph.llm import divergence, mixing
from weftgraph.llm.prefix import running

# ---- conversation repair ---------------------------------------------------------------------------------------------


def plain_faults(rows):
    """rows: (turn, role, text), sorted. Fault of each."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        first = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(first)
    return out


def plain_repair(rows):
    """Cheapest edits by a shortest-path search over (rows done, what has been written); least audit among them."""
    fault = plain_faults(rows)
    ok = re.compile(r"(s?(ua)+)?")
    prefix = re.compile(r"|s|s?(ua)*u?")
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, initials, written = heapq.heappop(heap)
        if at == len(rows) and ok.fullmatch(initials):
            return cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest()
        # only the last initial and emptiness matter for what may follow
        key = (at, initials[-1:], bool(initials))
        if key in done:
            continue
        done[key] = True
        nexts = []
        for role in ("user", "assistant"):
            nexts.append((cost + 5, audit + "I", at, initials + role[0], (*written, f"{role}:")))
        if at < len(rows):
            _, own, text = rows[at]
            nexts.append((cost + 2, audit + "D", at + 1, initials, written))
            if fault[at] not in ("blank", "duplicate"):
                late = 5 if fault[at] == "truncated" else 0
                nexts.append((cost + late, audit + "K", at + 1, initials + (own[:1] or "-"), (*written, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    nexts.append((cost + 1 + late, audit + "R", at + 1, initials + role[0], (*written, f"{role}:{text}")))
        for n in nexts:
            if prefix.fullmatch(n[3]):
                heapq.heappush(heap, n)


def plain_summary(rows):
    fault = plain_faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = Counter(fault)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, *plain_repair(rows))


CONV = "conv_id long, turn long, role string, text string"


def order(r):
    return (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_repair_equals_shortest_path(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rng = random.Random(block)
    rows, want = [], {}
    for conv in range(120):
        own = []
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
            text = rng.choice(["Yes.", "No!", "and then", " \t", "", "Why? ", f"n{turn}.", "é…"])
            own.append((rng.choice([turn, turn + 2, None, 5]), role, text))
        own.sort(key=order)
        rows += [(conv, *r) for r in own]
        want[conv] = plain_summary(own)
    rng.shuffle(rows)
    got = {r.conv: tuple(r)[1:] for r in cr.Repair(spark.createDataFrame(rows, CONV)).summary().collect()}
    assert got == want


def test_repair_nulls_empty_ids_and_extra_columns(spark):
    rows = [(None, None, None, None, 1, "x"), (None, 0, "user", "Hi.", 1, "x"), (1, None, "user", None, 1, "x"), (2, 3, "assistant", "A.", 1, "x"), (2, 7, "user", "B?", 1, "x")]
    df = spark.createDataFrame(rows, CONV + ", kind int, conv string")
    ids = spark.createDataFrame([(9,), (2,)], "conv_id long")
    repair = cr.Repair(df, ids)
    got = {r.conv: r for r in repair.summary().collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert set(got) == {None, 1, 2, 9}
    assert tuple(got[9])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert tuple(got[1])[1:] == (0, 1, 0, 0, 0, 2, "D", empty)
    assert got[None].audit == "DD" and got[None].illegal == 1  # the row without a role comes first
    assert (got[2].gaps, got[2].audit, got[2].cost) == (3, "RR", 2)
    assert [(r.conv, r.role, r.text, r.edit, r.turn) for r in repair.rows().orderBy("position").collect()] == [(2, "user", "A.", "R", 3), (2, "assistant", "B?", "R", 7)]
    none = cr.Repair(spark.createDataFrame([], CONV))
    assert none.summary().count() == 0 and none.rows().count() == 0


def test_repaired_rows_follow_the_grammar(spark, sf_dir):
    rows = cr.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    repair = cr.Repair(rows)
    made = defaultdict(list)
    for r in repair.rows().collect():
        made[r.conv].append((r.position, r.role, r.text))
    for r in repair.summary().collect():
        own = sorted(made[r.conv])
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[1][0] for x in own))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in own).encode()).hexdigest()


def test_one_conversation_of_many_rows_and_a_very_long_text(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"Turn {t}.") for t in range(5000) if t % 1000 != 500]
    rows += [(2, 0, "user", "long words " * 200_000 + "."), (2, 1, "assistant", "Yes.")]
    got = {r.conv: r for r in cr.Repair(spark.createDataFrame(rows, CONV)).summary().collect()}
    # each of the five missing user rows leaves an assistant row before another; the cheapest mend is to delete one of the two
    assert (got[1].gaps, got[1].illegal, got[1].cost, got[1].audit.count("D")) == (5, 5, 10, 5)
    assert got[2].audit == "KK" and got[2].cost == 0


def test_equal_remainders_share_nodes():
    a = cr.Automaton([cr.END])
    a.read("suaua")
    assert a.made == 5
    a.read("ouaua")
    assert a.made == 6  # only the first symbol is new
    a.read("uaua")
    assert a.made == 6 and a.audit(0, True) == ("KKKK", 0, 3)


# ---- source mixing ---------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), ceiling=3):
    """Rounds of sharing, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), Fraction(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > ceiling * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            target[s] = Fraction(ceiling * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source = rng.choice(["a", "b", "b", "b", "b", "c", "é", "tiny" if i % 50 == 0 else "b", None])
        n = rng.choice([0, 1, 5, 30, 200])
        rows.append((i, source, None if i % 97 == 0 else " word" * n))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))
    got = mixing.mix_sources(df).collect()
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in got:
        assert r.size == len((r.row.text or "").split()) and 0 <= r.taken <= 3 * r.size and r.row.size == "clash"
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    want = plain_targets(sizes)
    assert len(got) == len(rows) and any(want[s] == 3 * sizes[s] for s in sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted((r.row.doc_id, r.taken) for r in got) == sorted((r.row.doc_id, r.taken) for r in again)
    copies = mixing.copies_of(mixing.mix_sources(df, carry=["doc_id"]))
    assert copies.count() == sum(r.copies for r in got)


def test_mixing_defined_cases(spark):
    kind = "doc_id long, source string, text string"
    assert mixing.mix_sources(spark.createDataFrame([], kind)).count() == 0
    empty = mixing.mix_sources(spark.createDataFrame([(1, "a", ""), (None, None, None), (1, "a", " \n")], kind)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in empty] == [(0, 0, 0.0, 0)] * 3
    one = mixing.mix_sources(spark.createDataFrame([(1, "a", "x " * 100_000)] * 4, kind)).collect()  # repeated, very long rows
    assert [(r.target, r.copies) for r in one] == [(400_000.0, 1)] * 4
    # a source of a third of the rows that are all equal, and its target at the ceiling
    rows = [(7, "z", "w")] * 1000 + [(i, "a", "w w w") for i in range(5)] + [(i, "b", "") for i in range(2000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, kind)).collect()
    assert {r.copies for r in got if r.source == "a"} == {3} and sum(r.taken for r in got) == pytest.approx(1015, abs=2)


def test_running_sums_over_borders(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id"), F.when(F.col("id") % 2 == 0, "n").alias("s")).repartition(6)
    got = running(df, ["k", "s"], [F.col("id").desc()], {"n": F.lit(1), "v": F.col("id")}, "t").collect()
    assert len(got) == 5000
    for r in got[::97]:
        later = [x for x in range(r.id + 1, 5000) if x % 3 == r.k and (x % 2 == 0) == (r.s == "n")]
        assert (r.n, r.v) == (len(later), sum(later))


# ---- divergence audit ------------------------------------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    have, counts, groups = defaultdict(Counter), defaultdict(Counter), sorted({d[:2] for d in docs})
    for lang, source, words in docs:
        have[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in have[lang].items() if n >= min_docs]
        own = [g for g in groups if g[0] == lang]
        n = {g: sum(counts[g][t] for t in kept) for g in own}
        p = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))
        whole = {t: sum(counts[g][t] for g in own) for t in kept}
        for g in own:
            pairs = [(-sum(abs(p(counts[g][t], n[g]) - p(counts[h][t], n[h])) for t in kept), h[1].encode()) for h in own if h != g]
            terms = [(p(whole[t], sum(n.values())) - p(counts[g][t], n[g]), t.encode()) for t in kept if counts[g][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(x for x in terms if x[0] < 0)[:top])):
                out |= {(*g, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


KIND = "lang string, source string, text string"


@pytest.mark.parametrize("k", [2, 16])
def test_divergence_equals_plain_sums(spark, monkeypatch, k):
    monkeypatch.setattr(divergence, "K", k)
    rng = random.Random(k)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Über", "ÜBER", "x9y", "naïve"]
    rows = []
    for i in range(900):
        lang = rng.choice(["en", "en", "de", None])
        source = f"s{rng.randrange(40)}" if lang == "en" else rng.choice(["a", "b", None])
        part = vocabulary[(int(source[1:]) if lang == "en" else 0) :]
        rows.append((lang, source, None if i % 83 == 0 else " ".join(rng.choices(part, k=rng.choice([0, 3, 25])))))
    rows += [("fr", "only", "seldom"), ("fr", "two", ""), ("xx", "one", None)]
    df = spark.createDataFrame(rows, KIND).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1))
    got = {tuple(r) for r in divergence.audit_divergence(df.select("n", "lang", "source", "text", "term"), min_docs=4, top=7).collect()}
    assert got == plain_audit(rows, 4, 7)


def test_uniform_quadrants_are_priced_without_cells(spark):
    """Sources that use disjoint parts of a wide vocabulary leave quadrants that both rows of a pair lack."""
    words = [f"t{chr(97 + i // 26 // 26)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(1500)]
    rows = [("en", f"s{s:02d}", " ".join(words[30 * s : 30 * s + 30])) for s in range(50) for _ in range(2)]
    assert {tuple(r) for r in divergence.audit_divergence(spark.createDataFrame(rows, KIND), min_docs=2).collect()} == plain_audit(rows, 2, 50)


def test_divergence_defined_cases(spark):
    assert divergence.audit_divergence(spark.createDataFrame([], KIND)).count() == 0
    rows = [("en", "a", "x " * 300_000), ("en", "b", "y"), ("en", "a", "x " * 300_000), ("en", "b", "y")]
    assert {tuple(r) for r in divergence.audit_divergence(spark.createDataFrame(rows, KIND), min_docs=2).collect()} == plain_audit(rows, 2, 50)
