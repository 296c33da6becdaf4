"""Near-duplicates and leakage against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarrymill.llm import leakage as L
from quarrymill.llm import neardup as N
from quarrymill.llm.words import runs, words
from tests.conftest import message, rows

VOCABULARY = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def brute(docs, threshold=0.6):
    sets = {i: runs(words(t), 3) for i, t in docs.items()}
    ids = sorted(i for i in sets if sets[i])
    return sorted((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))


def make(rng):
    docs = {}
    for g in range(25):
        base = text(rng, rng.randint(40, 160))
        docs[f"g{g:02}#0"] = base
        for k in range(1, rng.randint(2, 6)):
            docs[f"g{g:02}#{k}"] = edited(rng, base, rng.choice([0, 1, 3, 6]))
    docs |= {f"x#{i}": text(rng, 80) for i in range(40)} | {"short#1": "a b", "short#2": "a b"}
    return docs


def test_pairs_match_brute_force(spark, conversations):
    rng = random.Random(7)
    docs = make(rng)
    data = [(i, [message("system", "w1 w2 w3 w4"), message("user", t), None, message("assistant", None)]) for i, t in docs.items()]
    df = conversations(data + data[:5] + [("none", None), ("blank", [message("user", " ")])]).withColumn("class", F.lit(1)).withColumn("bands", F.lit(1))
    want = brute(docs)
    assert len(want) > 60 and rows(N.alike_pairs(df), "id_a", "id_b") == want
    g = {r.id: r for r in N.groups(df).collect()}
    assert len(g) == len(docs) - 2
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    assert all(g[i].group_id == find(i) for i in g)


def test_hot_bucket_in_blocks(spark):
    members = spark.createDataFrame([(1, f"m{i:03}") for i in range(90)] + [(2, "m000"), (2, "m001"), (3, "alone")], "bucket BIGINT, id STRING")
    got = rows(N.candidate_pairs(members, block=16))
    assert len(got) == 90 * 89 // 2 and len(set(got)) == len(got) and all(a < b for a, b in got)


def test_probminhash_estimates(spark):
    rng = np.random.default_rng(1)
    a, b = np.arange(1, 901, dtype=np.uint64), np.arange(301, 1201, dtype=np.uint64)
    h = lambda x: N.mix(x * np.uint64(0x9E3779B97F4A7C15))
    doc = np.concatenate([np.zeros(900, np.int64), np.ones(900, np.int64)])
    sig = N.probminhash(doc, np.concatenate([h(a), h(b)]), None, 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05
    w = np.concatenate([rng.uniform(0.5, 2, 900), rng.uniform(0.5, 2, 900)])
    sig = N.probminhash(doc, np.concatenate([h(a), h(b)]), w, 2, 2048)
    wa, wb = dict(zip(a.tolist(), w[:900])), dict(zip(b.tolist(), w[900:]))
    both = set(wa) & set(wb)
    union = set(wa) | set(wb)
    jp = sum(1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in union) for x in list(both)[::10]) * 10
    assert abs((sig[0] == sig[1]).mean() - jp) < 0.06


def test_empty_input(spark, conversations):
    assert N.alike_pairs(conversations([])).count() == 0 and N.groups(conversations([])).count() == 0


def myers_table(p, t):
    best, row = len(p), list(range(len(p) + 1))
    for w in t:
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_myers_against_table():
    rng = random.Random(3)
    for _ in range(200):
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 90))], [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        assert L.myers_distance(p, t) == myers_table(p, t)


def test_bound_never_loses(spark):
    rng = random.Random(4)
    for n in (5, 9, 12, 17, 40, 83):
        item = L.Item(1, " ".join(f"u{i}" for i in range(n)), 5, L.piece_length())
        for _ in range(300):
            w = [x if rng.random() > 0.25 else "#" for x in item.words]
            hit = {j for j, s in enumerate(item.starts) if "#" not in w[s : s + item.size]}
            share = len(item.runs & runs(w, 5)) / len(item.runs)
            assert item.most(hit) >= share - 1e-9 and (share < 0.4 or hit)


def test_inserted_and_repeated_words_lose_no_leak():
    """Pieces of any length up to a run: the word goes in, or words are said again, inside or behind every k-th piece."""
    w = [f"u{i}" for i in range(100)]
    matcher = L.Matcher([(1, " ".join(w))], L.RUN, L.THRESHOLD)
    lost, kept = [], 0
    for every in range(3, 17):
        for at in range(every):
            for back in (0, 1, 2, 3):
                doc = []
                for i, x in enumerate(w):
                    if i % every == at and i:
                        doc += w[max(0, i - back) : i] if back else ["zz"]
                    doc.append(x)
                share = len(runs(w, 5) & runs(doc, 5)) / 96
                found = [x[0] for x in matcher.leaks(" ".join(doc))]
                kept += bool(found)
                if found != ([1] if share >= 0.4 else []):
                    lost.append((every, at, back, share))
    assert not lost and kept > 50
    by_hand = " ".join(x if i % 8 != 2 else x + " zz" for i, x in enumerate(w))
    assert [x[4] for x in matcher.leaks(by_hand)] == [round(len(runs(w, 5) & runs(by_hand.split(), 5)) / 96, 6)]


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    stock = text(rng, 12)
    items = {i: (stock + " " if i % 2 else "") + text(rng, rng.randint(12, 70)) for i in range(40)}
    docs = {}
    for d in range(200):
        t = text(rng, rng.randint(0, 150)) + " " + stock
        for i in rng.sample(list(items), rng.choice([0, 0, 1, 2])):
            w = edited(rng, items[i], rng.choice([0, 2, 5, 9])).split()
            cut = rng.randint(0, len(w) // 2)
            t += " ! " + ", ".join(w[cut:]).upper() + " " + text(rng, 20)
        docs[d] = t
    want = sorted((d, i) for d, t in docs.items() for i, x in items.items() if len(runs(words(t), 5) & runs(words(x), 5)) >= 0.4 * len(runs(words(x), 5)))
    df = spark.createDataFrame([*docs.items(), (900, None), (901, ""), (902, "w1 w2"), (None, items[3])], "doc_id BIGINT, text STRING").withColumn("item_id", F.lit("x"))
    it = spark.createDataFrame([*items.items(), (3, items[3]), (50, None), (51, ""), (52, "too short text")], "item_id BIGINT, text STRING").withColumn("doc_id", F.lit(1))
    got = L.leaked_items(df, it)
    assert sorted((r.doc_id, r.item_id) for r in got.collect() if r.doc_id is not None) == want and len(want) > 50
    assert got.where("doc_id IS NULL AND item_id = 3").count() == 1
    assert sorted((r.doc_id, r.item_id) for r in L.leaked_items(df, it, item_bytes=600).where("doc_id IS NOT NULL").collect()) == want
    assert L.leaked_items(df, it.limit(0)).count() == 0 and L.leaked_items(df.limit(0), it).count() == 0


def test_components_of_a_long_path_are_whole(spark):
    n = 301
    order = list(range(n))
    random.Random(9).shuffle(order)
    links = spark.createDataFrame([(f"n{order[i]:04}", f"n{order[i + 1]:04}") for i in range(n - 1)] + [("z1", "z2"), ("z2", "z1"), ("z3", "z3")], "id_a STRING, id_b STRING")
    got = dict(rows(N.components(links), "id", "group_id"))
    assert len(got) == n + 2 and {v for k, v in got.items() if k[0] == "n"} == {"n0000"} and got["z2"] == "z1"
    assert N.components(links.limit(0)).count() == 0


def test_weighted_pairs_match_brute_force(spark, conversations):
    """Multisets: runs that occur more often weigh more, so that repeated passages can make or break a pair."""
    from collections import Counter

    rng = random.Random(11)
    docs = {}
    for g in range(12):
        a, b = text(rng, 40), text(rng, 40)
        docs |= {f"g{g:02}#0": f"{a} {b}", f"g{g:02}#1": f"{a} {b} {b} {b}", f"g{g:02}#2": f"{edited(rng, a, 2)} {b} {b} {b}", f"g{g:02}#3": f"{a} {a} {b}"}
    count = {k: Counter(zip(*(words(t)[i:] for i in range(3)))) for k, t in docs.items()}
    ids = sorted(docs)
    want = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sum((count[a] & count[b]).values()) >= 0.6 * sum((count[a] | count[b]).values())]
    df = conversations([(k, [message("user", t)]) for k, t in docs.items()])
    assert want and rows(N.alike_pairs(df, weights="counts"), "id_a", "id_b") == want and want != rows(N.alike_pairs(df), "id_a", "id_b")


def test_bitmap_keeps_all_candidates(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("x"))
    wanted = df.where("id % 7 = 0").select("id")
    kept = N.maybe_among(df, wanted)
    assert kept.columns == ["id", "x"] and kept.join(wanted, "id", "left_semi").count() == wanted.count() and kept.count() < 1.05 * wanted.count()
    assert N.maybe_among(df, wanted.limit(0)).count() == 0


def test_distance_bounds_the_runs_a_document_holds():
    """What Myers' distance allows is never less than the runs that are there, whatever edits were made; and it rejects."""
    rng = random.Random(21)
    rejected = 0
    for n in (7, 14, 30, 90):
        w = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n)]
        matcher = L.Matcher([(1, " ".join(w))], L.RUN, L.THRESHOLD)
        item = matcher.items[0]
        for _ in range(150):
            doc = list(w)
            for _ in range(rng.randrange(1, n)):
                at = rng.randrange(len(doc) + 1)
                doc[at : at + rng.randrange(2)] = [rng.choice(w)] * rng.randrange(3)
            doc = doc[rng.randrange(n // 2 + 1) :] + ["zz"] + w[: rng.randrange(n)]
            at = [(j, d) for j, s in enumerate(item.starts) for d in range(len(doc)) if doc[d : d + item.size] == w[s : s + item.size]]
            if at:
                most, leaked, distance = matcher.verify(item, at, doc)
                assert most >= len(item.runs & runs(doc, 5)) and 0 <= leaked <= n and distance >= 0
                rejected += most < 0.4 * len(item.runs)
    assert rejected
