import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.decontaminate import MASKS, clean_only, decontaminate, masks_for

SPLIT = re.compile(r"[\W_]+")


def toks(t):
    return [w for w in SPLIT.split((t or "").lower()) if w]


def brute(docs, items, window=13, similarity=0.8, min_words=5):
    """Every item against every document on every diagonal on which a word agrees, and all windows, without seeds."""
    items = [(k, toks(t)) for k, t in items if len(toks(t)) >= min_words]
    out = []
    for d, t in docs:
        w, found = toks(t), []
        at = {}
        for i, x in enumerate(w):
            at.setdefault(x, []).append(i)
        for k, item in items:
            n = min(window, len(item))
            agree = {}
            for j, x in enumerate(item):
                for i in at.get(x, ()):
                    agree.setdefault(i - j, set()).add(j)
            if any(sum(j in g for j in range(s, s + n)) / n >= similarity for g in agree.values() if len(g) >= similarity * n for s in range(len(item) - n + 1)):
                found.append(k)
        out.append((d, sorted(set(found))))
    return out


def corpus(rng):
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, text(rng.choice([3, 6, 9, 15, 40]))) for k in range(20)]
    docs = []
    for d in range(60):
        body = text(rng.choice([0, 1, 8, 60, 300]))
        if d % 3 == 0:
            _, it = rng.choice(items)
            part = list(it)
            for i in range(len(part)):
                if rng.random() < 0.1:
                    part[i] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((d, " ".join(body).capitalize() + "."))
    return docs, [(k, ", ".join(t)) for k, t in items]


def test_matches_brute_force(spark):
    docs, items = corpus(random.Random(3))
    docs += [(900, None), (901, ""), (902, items[4][1]), (902, "other text"), (None, "  "), (None, items[4][1]), (None, "clean"), (903, "word " * 60_000 + items[4][1])]
    items += [(77, None), (78, ""), (79, "one two three"), items[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("seed", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(((r["doc_id"], r["item_ids"]) for r in decontaminate(d, b).collect()), key=str)
    want = sorted(brute(docs, items), key=str)
    assert got == want and sum(1 for _, x in want if x) > 10
    assert sorted(((r["doc_id"], r["item_ids"]) for r in decontaminate(d, b, block_words=60).collect()), key=str) == want
    assert sorted((r["doc_id"] for r in clean_only(d, b).collect()), key=str) == sorted((k for k, x in want if not x), key=str)


@pytest.mark.parametrize("sieve_bits", [16, 24])
def test_a_benchmark_of_many_blocks_is_shuffled_and_gives_the_same(spark, sieve_bits):
    docs, items = corpus(random.Random(8))
    docs += [(900, None), (901, ""), (902, items[4][1]), (902, "other text"), (None, items[4][1]), (None, items[4][1]), (None, "clean"), (903, "word " * 60_000 + items[5][1])]
    quoted = next(t for _, t in items if len(toks(t)) >= 15)
    docs += [(1000 + i, f"start{i} {quoted}") for i in range(200)]
    items += [(77, None), (78, ""), (79, "one two three"), items[0], (80, " ".join(f"long{i}" for i in range(500)))]
    docs += [(1300, " ".join(f"long{i}" if i % 6 else "zz" for i in range(100, 130)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("seed", F.lit("x")).withColumn("p", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("salt", F.lit("x"))
    way = {"block_words": 60, "most_blocks": 1, "sieve_bits": sieve_bits}
    got = sorted(((r["doc_id"], r["item_ids"]) for r in decontaminate(d, b, **way).collect()), key=str)
    assert got == sorted(brute(docs, items), key=str) and sum(1 for _, x in got if x) > 200
    one = {(r["doc_id"], tuple(r["item_ids"]), r["matched"]) for r in decontaminate(d, b).collect()}
    assert {(r["doc_id"], tuple(r["item_ids"]), r["matched"]) for r in decontaminate(d, b, **way).collect()} == one
    assert decontaminate(d.limit(0), b, **way).count() == 0


def test_tolerates_substitutions_and_leaves_clean_documents(spark):
    item = [f"t{i}" for i in range(30)]
    changed = [w if i % 7 != 3 else "zz" for i, w in enumerate(item)]
    half = [w if i % 2 else "zz" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(["a"] * 50 + changed)), (2, " ".join(half)), (3, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"]: r["contaminated"] for r in decontaminate(docs, bench).collect()} == {1: True, 2: False, 3: False}
    assert sorted(r["doc_id"] for r in clean_only(docs, bench).collect()) == [2, 3]
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert clean_only(docs, bench.limit(0)).count() == 3


def quotes():
    """An excerpt of an item of each size, with every choice of the most substitutions that are allowed, and one more."""
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 30)]
    docs = []
    for n, text in items:
        size, first = min(13, n), 9 if n == 30 else 0
        most = size - math.ceil(0.8 * size)
        for changed in [*itertools.combinations(range(size), most), tuple(range(most + 1))]:
            part = [f"s{j}" if j in changed else w for j, w in enumerate(text.split()[first : first + size])]
            docs.append((len(docs), " ".join(["before", *part, "after"] if len(docs) % 2 else part)))
    return docs, items


def test_all_allowed_substitutions_are_found_in_items_of_every_size(spark):
    docs, items = quotes()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = dict(brute(docs, items))
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate(d, b).collect()}
    assert got == want and sum(map(bool, want.values())) == len(docs) - len(items)


@pytest.mark.parametrize(("size", "similarity"), [(13, 0.8), (5, 0.8), (12, 0.7), (10, 0.5), (30, 0.8)])
def test_masks_leave_no_choice_of_substitutions_out(size, similarity):
    masks = masks_for(size, similarity, MASKS)
    most = max(d for d in range(size) if (size - d) / size >= similarity)
    rng = random.Random(1)
    choices = itertools.combinations(range(size), most) if size < 14 else [rng.sample(range(size), most) for _ in range(2000)]
    for changed in choices:
        assert any(all(c == "0" or at + i not in changed for i, c in enumerate(m)) for m in masks for at in range(size - len(m) + 1))


@pytest.mark.parametrize("way", [{}, {"block_words": 60, "most_blocks": 1}])
def test_a_long_text_that_quotes_all_along_is_held_in_pieces(spark, way):
    """Each hit held the whole text, as often as the benchmark repeats the item, until the text was done."""
    said = [f"q{i}" for i in range(120)]
    docs = [(1, " ".join(said * 100)), (2, " ".join(["pad"] * 122 + said[:13])), (3, " ".join(["pad"] * 5000 + said[100:112] + ["pad"])), (4, " ".join(said[::2] * 50))]
    items = [(100 + k, " ".join(said)) for k in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["item_ids"], r["matched"]) for r in decontaminate(d, b, **way).collect()}
    ids = [k for k, _ in items]
    assert got == {1: (30, ids, 1.0), 2: (30, ids, 1.0), 3: (30, ids, round(12 / 13, 6)), 4: (0, [], 0.0)}
    assert [r["doc_id"] for r in clean_only(d, b, **way).collect()] == [4]
