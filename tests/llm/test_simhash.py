import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import registry, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(prints, bits=3):
    """``component_id`` of each of ``prints (doc_id, fp)``: the least id that is not null, by all pairs."""
    known = sorted({p for _, p in prints})
    arr, root = np.array(known, np.uint64), list(range(len(known)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, p in enumerate(arr):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ p) <= bits).tolist():
            root[top(i)] = top(i + 1 + j)
    at, least = {p: top(k) for k, p in enumerate(known)}, {}
    for d, p in prints:
        if d is not None:
            least[at[p]] = min(d, least.get(at[p], d))
    return [(d, f"{p:016x}", least.get(at[p])) for d, p in prints]


def sort(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_hash_is_the_one_of_spark_and_blocks_change_nothing(spark, monkeypatch):
    texts = ["a b c", "one  Two\nthree\x0bfour\x1cfive", "é Éa   x y", "x", "", " \t ", "a a a a a"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == brute_print(t)
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (1 << 64) - 1 == next(simhash.shingle_hashes(b"a b c", 3, 42))[0]
    rnd = random.Random(1)
    long = " ".join(rnd.choice(["Alpha", "beta", "é", "x" * 40, "\n"]) for _ in range(4000))
    whole = simhash.fingerprint(long.encode())
    for block in (1, 7, 1000):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert simhash.fingerprint(long.encode()) == whole == brute_print(long)
        for t in texts:
            assert simhash.fingerprint(t.encode()) == brute_print(t)


@pytest.mark.parametrize("crowd", [1, 3, 50, 4096])
def test_all_links_within_three_bits_however_crowded_the_keys(spark, crowd):
    rnd = random.Random(crowd)
    flip = lambda x, n: x ^ sum(1 << k for k in rnd.sample(range(64), n))
    seeds = [rnd.getrandbits(64) for _ in range(20)]
    known = {0, (1 << 64) - 1, *seeds}
    for s in seeds:  # pairs at 1 to 5 bits
        known |= {flip(s, n) for n in range(1, 6)}
    hub = rnd.getrandbits(64)  # a crowd that shares nearly all bits, and a chain of steps of three bits
    known |= {hub ^ sum(1 << k for k in rnd.sample(range(20, 44), rnd.randint(0, 4))) for _ in range(300)}
    step = hub ^ (1 << 63)
    for _ in range(30):
        known.add(step := flip(step, 3))
    rows = [(i, p) for i, p in enumerate(known)]
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for _, p in rows], "fp long")
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.near_fingerprints(nodes, crowd=crowd).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {p: p for p in known}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[top(a)] = top(b)
    want = {i: c for i, _, c in brute_classes(rows)}
    groups = {}
    for i, p in rows:
        groups.setdefault(top(p), []).append(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in want if want[i] == c) for c in set(want.values()))


def test_a_crowd_is_not_listed_pair_by_pair(spark):
    nodes = spark.range(4096).select((F.col("id") * 7).alias("fp"))
    assert simhash.near_fingerprints(nodes).count() <= 64 * 4096


def test_edge_cases(spark):
    long = " ".join(f"w{i * i % 977}" for i in range(60_000))
    near = long.replace("w1 ", "w2 ", 1)
    texts = [(1, "a b c d"), (2, None), (3, ""), (4, " \n"), (5, "A B C D"), (None, "a b c d"), (5, "x y"), (5, "x y"), (None, "alone at last"), (None, None), (7, long), (6, near), (8, "q")]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in texts], "doc_id long, text string, fp int, root string")
    got = simhash.simhash_classes(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sort(got.collect()) == sort(brute_classes([(i, brute_print(t)) for i, t in texts]))
    assert simhash.simhash_classes(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_fingerprints(spark.range(1).withColumnRenamed("id", "fp"), bits=4)


def test_hot_copies(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one hot text here").otherwise(F.concat(F.lit("text number "), "id")).alias("text"))
    rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    assert sort(simhash.simhash_classes(docs).collect()) == sort(brute_classes(rows))


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sort(registry.op11_simhash(spark, sf).collect())
    assert got == sort(brute_classes([(d, brute_print(t)) for d, t in docs]))
    assert len({c for _, _, c in got}) < len(got)
