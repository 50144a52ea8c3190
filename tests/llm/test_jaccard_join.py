import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import jaccard_join
from tessera.llm.components import components
from tessera.llm.jaccard_join import _pack, _unpack, KINDS, list_pairs, similarity_classes
from tessera.llm.textnum import shingles


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    least = {}
    low = lambda x: (x is not None, x or 0)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least else min(least[r], d, key=low)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(3000)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared, rows = text(60), []
    bases = [text(rng.choice([5, 12, 40, 120])) for _ in range(n // 8)]
    for d in range(n):
        kind = d % 4
        if kind == 0:
            w = text(rng.choice([1, 3, 5, 9, 80]))
        elif kind == 1:
            w = shared + text(rng.randint(0, 40))
        else:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            w = w[rng.randint(0, 3) :] if len(w) > 30 else w
        rows.append((d * 7 % 1000, " ".join(w)))
    return rows


def test_matches_brute_force(spark):
    rng = random.Random(6)
    rows = corpus(rng, 360)
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "Alpha Beta"), (2004, "alpha\nbeta"), (2005, "alpha  gamma"), (2006, "É é a b c"), (2007, "é é a b c"), (None, "solo text"), (2008, "SOLO text"), rows[5], rows[6]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("sid", F.lit(1)).repartition(6)
    for more in ({}, {"hashes": 1, "entries_a_bucket": 50}, {"hashes": 1, "longest": 4}):
        got = sorted((tuple(r) for r in similarity_classes(docs, **more).collect()), key=str)
        assert got == brute(rows)
    assert len({r[2] for r in brute(rows)}) < 330
    assert similarity_classes(docs.limit(0)).count() == 0
    assert {tuple(r) for r in similarity_classes(docs.filter("doc_id >= 2000 AND doc_id < 2003")).collect()} == {(2000, 0, 2000), (2001, 0, 2001), (2002, 0, 2002)}


def test_near_copies_around_a_leader_match_brute_force(spark, monkeypatch):
    """Copies with few to many changes: some near their leader, some near others only, some near none; also with lists split into blocks."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for base in range(2):
        words = [rng.choice(vocab) for _ in range(90)]
        variant = [w if i not in (10, 11, 40, 70) else "v" for i, w in enumerate(words)]
        for k in range(110):
            w = list(variant if k % 3 == 0 else words)
            for _ in range(rng.randint(0, 5)):
                at, kind = rng.randrange(len(w)), rng.random()
                w[at : at + 1] = [] if kind < 0.2 else [rng.choice(vocab), w[at]] if kind < 0.4 else [rng.choice(vocab[:40])]
            rows.append((base * 1000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len({r[2] for r in want}) > 10
    assert sorted((tuple(r) for r in similarity_classes(docs).collect()), key=str) == want
    assert sorted((tuple(r) for r in similarity_classes(docs, longest=16).collect()), key=str) == want
    whole = jaccard_join.links_by_leader
    monkeypatch.setattr(jaccard_join, "links_by_leader", lambda *a, **k: whole(*a, **k, longest=7))
    monkeypatch.setattr(jaccard_join, "overlaps", lambda *a, f=jaccard_join.overlaps, **k: f(*a, **k, chunk=3))
    assert sorted((tuple(r) for r in similarity_classes(docs).collect()), key=str) == want


def test_shingles_match_plain_sets():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd\n e\tF g ".split(" ")) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["x" * 600_000, "a b c d e f"]
    got = list(shingles([t.encode() for t in texts]))
    assert [len(g) for g in got] == [len(shingle_set(t)) for t in texts]
    ids = {}
    for t, g in zip(texts, got, strict=True):  # one hash for each shingle, everywhere
        assert frozenset(g.tolist()) == ids.setdefault(frozenset(shingle_set(t)), frozenset(g.tolist()))


def test_list_pairs_keeps_every_pair_that_can_suffice():
    rng = np.random.default_rng(2)
    n = np.sort(rng.integers(5, 60, 200))
    p = np.array([rng.integers(0, max(1, x // 5 + 1)) for x in n])
    order = np.lexsort((p, n))
    n, p, roots = n[order], p[order], rng.integers(0, 30, 200)
    got = {tuple(sorted(x)) for u, v in list_pairs(roots, n, p, (80, 100)) for x in zip(u.tolist(), v.tolist(), strict=True)}
    want = set()
    for i in range(200):
        for j in range(i):
            best = min(n[i] - p[i], n[j] - p[j])
            if roots[i] != roots[j] and 180 * best >= 80 * (n[i] + n[j]):
                want.add((j, i))
    assert got == want


def test_pack_round_trip():
    cols = [np.arange(50).astype(k) for k in KINDS]
    assert all((x == y).all() for x, y in zip(_unpack(_pack(*cols), KINDS), cols, strict=True))


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(7, 7), (200, 300), (300, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(40)}, 200: 200, 300: 200}
