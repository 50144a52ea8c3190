"""The registered queries of the learned operators, with their production parameters, against plain Python on a small corpus."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import quality, registry
from tessera.llm.linear import sigmoid
from tessera.llm.textnum import word_hashes
from tests.llm.test_language_id import grams

LEXICON = {"de": "der die das hund katze und läuft über haus", "en": "the a cat dog and runs over house it's", "fr": "le la chien chat et court sur maison été"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Texts of three languages, some mixed, without a language, repeated, empty or null; and quality labels of some."""
    rng, rows = random.Random(11), []
    for i in range(240):
        lang = rng.choice(sorted(LEXICON))
        pool = LEXICON[lang].split() + (LEXICON["en"].split() if i % 12 == 0 else [])
        words = [rng.choice(pool) for _ in range(rng.randint(1, 60))]
        text = " ".join(w.upper() if i % 4 == 0 and k % 2 else w + rng.choice(["", ",", "."]) for k, w in enumerate(words))
        rows.append((i, text, None if i % 17 == 0 else lang))
    rows += [(300, None, "de"), (301, "", None), (302, "12 !?", "en"), (303, rows[5][1], "fr"), (304, "qqq", None)]
    labels = [(i, i % 4 == 0, 0) for i in range(0, 240, 2)]
    root = str(tmp_path_factory.mktemp("brute"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(not bad), t) for i, bad, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, rows, {i: int(not bad) for i, bad, _ in labels}


def test_op4_follows_from_plain_counts_with_the_registered_share(spark, corpus):
    root, rows, _ = corpus
    known = [(t.lower(), x) for i, t, x in rows if x and t is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    langs = sorted({x for _, x in known})
    counts = {x: Counter(g for t, at in known if at == x for g in grams(t)) for x in langs}
    whole = {x: Counter() for x in langs}
    for x in langs:
        for g, n in counts[x].items():
            whole[x][len(g)] += n
    holds = {x: {g for g, n in counts[x].items() if n >= 1e-5 * whole[x][len(g)]} for x in langs}
    most = Counter(x for _, x in known)
    got = {r["doc_id"]: r for r in registry.op4_language_id(spark, root).collect()}
    assert sorted(got) == sorted(i for i, _, _ in rows)
    for i, t, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        n = {x: sum(g in holds[x] for g in grams(t.lower())) for x in langs}
        total = sum(n.values())
        if total:
            assert abs(got[i]["score"] - max(n.values()) / total) < 0.01
            assert n[got[i]["lang_pred"]] >= max(n.values()) - 0.02 * total
        else:
            assert got[i]["lang_pred"] == most.most_common(1)[0][0] and got[i]["score"] == 0


def plain_features(text):
    """Bins and values of one text: shares of lower-case words and of squeezed token shapes, and five bands."""
    raw = text.encode()
    place = lambda w: int(word_hashes(np.frombuffer(b" " + w + b" ", np.uint8), np.array([1]), np.array([1 + len(w)]))[0]) >> (64 - quality.BITS)
    kind = lambda c: "A" if 65 <= c < 91 else "a" if 97 <= c < 123 or c >= 128 else "9" if 48 <= c < 58 else chr(c)
    tokens = re.findall(rb"[^ \t-\r]+", raw)
    words = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in tokens]
    shapes = [re.sub(r"(.)\1+", r"\1", "".join(map(kind, w)), flags=re.S).encode() for w in tokens]
    n, size = max(1, len(words)), max(1, len(raw))
    out = Counter()
    for w in words + shapes:
        out[place(w)] += quality.SPREAD / n
    kinds = Counter(map(kind, raw))
    signs = sum(v for k, v in kinds.items() if k not in "Aa \t\n\v\f\r")
    shares = (len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, kinds["A"] / size, signs / size, min(1.0, math.log2(1 + len(words)) / 16))
    for m, s in enumerate(shares):
        out[(1 << quality.BITS) + quality.BANDS * m + min(quality.BANDS - 1, int(s * quality.BANDS))] += 1.0
    return out


def test_op9_features_are_those_of_plain_python(corpus):
    texts = [t or "" for _, t, _ in corpus[1]] + ["aa aa  AA\tb1 22\n..", " é É x", "\v\f", "the " * 200_000, "Ab"]
    indptr, indices, values = quality.features([t.encode() for t in texts])
    for k, t in enumerate(texts):
        got = Counter()
        for i, v in zip(indices[indptr[k] : indptr[k + 1]], values[indptr[k] : indptr[k + 1]], strict=True):
            got[int(i)] += v
        want = plain_features(t)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want), t[:50]


def test_op9_decisions_follow_from_weights_and_plain_features(spark, corpus):
    root, rows, labels = corpus
    lowest = {}
    for i, t, _ in rows:
        if i in labels and t is not None:
            lowest[t] = min(labels[i], lowest.get(t, 1))
    model = quality.learn(spark.createDataFrame(list(lowest.items()), "text string, label int"), 16)
    got = {r["doc_id"]: r for r in registry.op9_quality(spark, root).collect()}
    assert sorted(got) == sorted(i for i, _, _ in rows) and model["grades"] == [0.0, 1.0]
    for i, t, _ in rows:
        tail = sigmoid(np.array([sum(model["weights"][k] * v for k, v in plain_features(t or "").items()) - model["thresholds"][0]]))[0]
        assert abs(got[i]["tail"] - tail) < 1e-3 and abs(got[i]["expected_grade"] - tail) < 1e-3
        assert got[i]["selected"] == (tail >= 0.5) or abs(tail - 0.5) < 1e-3
    assert all(got[i]["selected"] == bool(q) for i, q in labels.items() if len(rows[i][1]) > 80)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_op10_posteriors_and_copies_are_those_of_plain_python(spark, corpus):
    root, rows, _ = corpus
    buckets, flat = 1 << 12, 0.5
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    bucket = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42)) % buckets
    langs = sorted({x for _, _, x in rows if x})
    counts = {x: Counter(bucket(w) for _, t, at in rows if at == x for w in words(t)) for x in langs}
    seen = set().union(*counts.values())
    n = Counter(x for _, _, x in rows if x)
    size = {x: sum(counts[x].values()) for x in langs}
    soft = {}
    for i, t, _ in rows:
        score = {x: math.log(n[x] / sum(n.values())) + flat * sum(math.log((counts[x][b] + 1) / (size[x] + buckets)) for b in map(bucket, words(t)) if b in seen) for x in langs}
        top = max(score.values())
        total = sum(math.exp(s - top) for s in score.values())
        soft[i] = {x: math.exp(score[x] - top) / total for x in langs}
    got = {r["doc_id"]: r for r in registry.op10_mixture(spark, root).collect()}
    assert sorted(got) == sorted(soft)
    expected = {x: sum(len(words(t)) * soft[i][x] for i, t, _ in rows) for x in langs}
    raw = {x: (v / sum(expected.values())) ** 0.7 for x, v in expected.items()}
    for i, t, _ in rows:
        r, best = got[i], max(soft[i].values())
        assert r["tokens"] == len(words(t)) and abs(r["posterior"] - best) < 1e-5 and soft[i][r["domain"]] > best - 1e-9
        h = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42))
        chance, part = (signed(h) % (1 << 24)) / (1 << 24), r["rate"] % 1
        assert r["rate"] >= 0 and (r["copies"] == math.floor(r["rate"]) + (chance < part) or abs(chance - part) < 1e-5)
    given = {x: sum(got[i]["rate"] * got[i]["tokens"] * soft[i][x] for i in got) for x in langs}
    assert all(abs(given[x] / sum(expected.values()) - raw[x] / sum(raw.values())) < 1e-3 for x in langs)
