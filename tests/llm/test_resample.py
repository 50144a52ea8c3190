import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import registry, resample
from tests.llm.test_simhash import sort


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words_of(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(rows, target, min_words=20, percent=25, seed=7):
    s, t = Counter(f for _, x in rows for f in features(x)), Counter(f for x in target for f in features(x))
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for doc_id, x in rows:
        f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sort(r[:5] for r in out)


@pytest.mark.parametrize("head", [(0, 0), (2, 1), (40, 30), (1000, 1000)])
def test_buckets_are_those_of_direct_crc(head):
    rnd = random.Random(2)
    vocabulary = [bytes(rnd.choice(b"abcxyz0189\xc3\xa9") for _ in range(rnd.randint(1, 64))) for _ in range(120)]
    words = [rnd.choice(vocabulary) for _ in range(2000)]
    pairs = list(zip(words, words[1:], strict=False))
    known = resample.Head([w for w, _ in Counter(words).most_common(head[0])], [p for p, _ in Counter(pairs).most_common(head[1])], 10_000)
    want = [zlib.crc32(w) % 10_000 for w in words] + [zlib.crc32(a + b" " + b) % 10_000 for a, b in pairs]
    assert known.of(words).tolist() == want
    assert sorted(np.concatenate([known.of(words[:700]), known.of(words[700:], words[699])]).tolist()) == sorted(want)
    assert known.of([]).tolist() == [] and known.of([b"q"]).tolist() == [zlib.crc32(b"q") % 10_000]


def test_long_texts_go_in_blocks(monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice(["Alpha", "é9", " ", "-", "\n", "x"]) for _ in range(3000)).encode()
    want = features(text.decode())
    for block in (1, 10, 1 << 20):
        monkeypatch.setattr(resample, "BLOCK", block)
        got = list(resample.Head([b"alpha", b"x"], [(b"x", b"x")], 10_000).features(text))
        assert sorted(f for _, fs in got for f in fs.tolist()) == sorted(want) and sum(n for n, _ in got) == len(words_of(text.decode()))


def make_rows():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "straße", "漢字", "x" * 90]
    rows = [(k, " ".join(rnd.choice(vocabulary[: 5 + k % 60]) for _ in range(rnd.randint(0, 60)))) for k in range(300)]
    rows += [(1000 + k, "same words here " * 8) for k in range(150)] + [(None, "w1 W2, w3. " * 10), (None, "w1 w2 w3 " * 10), (None, None), (7, None), (8, ""), (9, " -- ")]
    return [*rows, (7, "w1 w2"), (7, "w1 w2"), (3, "again " * 30), (3, "again " * 30), (4, "long text, é " * 30_000)]


def test_rows_and_any_size_of_the_head(spark):
    rows = make_rows()
    target = ["w1 w2 w3 w4", "W50 straße", None, "", "again again"]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, rank int")
    items = spark.createDataFrame([(t, 3) for t in target], "text string, doc_id int")
    want = brute(rows, target)
    for kw in ({}, {"head_words": 3, "head_pairs": 2}, {"head_words": 1, "head_pairs": 0}):
        got = resample.resample(docs, items, **kw)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sort(got.collect()) == want
    assert sort(resample.resample(docs, items, min_words=1, percent=100, seed=3).collect()) == brute(rows, target, 1, 100, 3)
    assert sort(resample.resample(docs, items.limit(0), percent=0).collect()) == brute(rows, [], percent=0)
    assert resample.resample(docs.limit(0), items).count() == 0


def test_query_against_brute_force(spark, sf):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    got = sort(registry.op13_resample(spark, sf).collect())
    assert got == brute(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")])
    assert max(r[4] or 0 for r in got) > 0
