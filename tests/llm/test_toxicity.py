import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import registry
from tessera.llm.toxicity import CharModel, char_model, decode, features, lattice, logits, present, restore, score_toxicity, trigrams

WORDS = {"idiot": 40, "stupid": 40, "the": 90, "this": 60, "trash": 30, "ring": 50, "ship": 50, "worthless": 20, "you": 90, "are": 80, "ass": 20}
COUNTS = Counter()
for w, n in WORDS.items():
    for t in trigrams(w):
        COUNTS[t] += n
CHARS = CharModel(dict(COUNTS))


@pytest.mark.parametrize("token", ["1d10t", "stuuupid", "idi0t", "tr@$h", "7h3", "i d.t", "1 5 t"])
def test_viterbi_finds_the_best_of_all_paths(token):
    def cost(path):
        h, c = "  ", sum(x[1] for x in path)
        for ch in "".join(x[0] for x in path) + " ":
            if (ch, h) != (" ", "  "):
                c += CHARS.cost(h, ch)
                h = "  " if ch == " " else h[1] + ch
        return c

    best = min(itertools.product(*lattice(token)), key=cost)
    said, spent = decode(token, CHARS)
    assert said == "".join(x[0] for x in best) and math.isclose(spent, cost(best))


def test_disguises_are_read_and_plain_text_stays():
    memo = {}
    pairs = {"you 1D10T!": "you idiot!", "i d i o t": "idiot", "s.t.u.p.i.d ship": "stupid ship", "stuuuupid": "stupid", "w0rthl3ss": "worthless", "tr@sh, ok": "trash, ok",
        "y0u.4r3.w0r7hl3ss.1d10t.y0u.1d10t": "you are worthless idiot you idiot", "i  d  i  o  t": "idiot", "i\nd\ni\no\nt": "idiot", "4$$": "ass", "idi" + "o" * 30 + "t": "idiot",
        "y o u  a r e  w o r t h l e s s  i d i o t  y o u  i d i o t": "you are worthless idiot you idiot",
    }
    assert {k: restore(k, CHARS, memo) for k in pairs} == pairs
    for same in ["", "the ship", "call +1 (456) 555-2186", "2024 100%", "a b", "17 000", "1234567", "http://example.com/" + "1" * 30]:
        assert restore(same, CHARS, memo) == same


@pytest.mark.parametrize(
    "text",
    ["i     d     i     o     t", "i,d,i,o,t", "i/d/i/o/t", "i~d~i~o~t", "i|d|i|o|t", "i\u200bd\u200biot", "id\u00adiot", "iidioot", "i . , d ;; i -- o\n\n\n\n\n\nt", "i_d_i_o_t", "i=d=1=0=t", "i" + " " * 50 + "d i o t", "I·D·I·O·T", "i$d$i$o$t"],
)
def test_any_separators_and_doubled_letters(text):
    assert restore(f"you {text} you", CHARS, {}) == "you idiot you" and restore(text, CHARS, {}) == "idiot"


def test_lists_and_sums_stay():
    for same in ["x + y = z", "1, 2, 3, 4", "a) b) c)", "x | y | z", "9 * 9 / 3"]:
        assert restore(same, CHARS, {}) == same


def test_features_match_plain_ones():
    """A word is a feature, and so are its first 4, 5 and 6 bytes if it is longer: equal features have equal numbers."""
    texts = ["an idiot, idiot", "", "stupidly stupid", "stupidity 12 é", "idio"]
    at, f = features([t.encode() for t in texts])
    name, plain = {}, []
    for k, t in enumerate(texts):
        words = [w.encode() for w in re.findall(r"[a-zé]+", t)]
        plain += [(k, ("whole", w)) for w in words] + [(k, ("head", w[:n])) for n in (4, 5, 6) for w in words if len(w) > n]
    got = Counter(zip(at.tolist(), f.tolist(), strict=True))
    assert sorted(got.values()) == sorted(Counter(plain).values()) and len(set(f.tolist())) == len({x for _, x in plain})
    chosen = np.sort(np.unique(features([b"idiot stupidity"])[1]))
    found = Counter(present([t.encode() for t in texts], chosen)[0].tolist())
    assert found == {0: 2, 2: 3, 3: 4}  # idiot, idio; stup, stupi, stupid; these and stupidity


def test_scores_match_a_plain_sum():
    chosen = np.sort(np.unique(features([b"idiot trash"])[1]))
    model = {"features": chosen, "strong": np.arange(len(chosen)) == 0, "weights": np.arange(1.0, len(chosen) + 2), "bias": -0.5}
    texts = [b"an idiot idiot", b"", b"trash", b"idiot trash ship"]
    for t, score in zip(texts, logits(texts, model), strict=True):
        mine = {int(np.searchsorted(chosen, x)) for x in features([t])[1] if x in chosen}
        assert math.isclose(score, -0.5 + sum(k + 1 for k in mine) + (len(chosen) + 1) * (0 in mine))


def test_character_model_counts_all_words(spark):
    docs = spark.createDataFrame([("The the cat",), (None,), ("", ), ("cat жж 12 é",)], "text string")
    want = Counter()
    for w, n in {"the": 2, "cat": 2, "жж": 1, "é": 1}.items():
        for t in trigrams(w):
            want[t] += math.log2(n + 1)
    got = char_model(docs, "text").tri
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_defined_results(spark):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice(["the", "ship", "ring", "sea", "sun"]) for _ in range(12))
    rows = [(i, clean() + (" idiot" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    lab = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = spark.createDataFrame([(1, "the 1d1ot ring"), (2, "the ship"), (3, None), (4, ""), (None, "i d i o t"), (6, "sea " * 40_000), (2, "the ship")], "doc_id long, text string")
    docs = docs.unionByName(lab.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    lab = lab.select((F.col("doc_id") + 1000).alias("doc_id"), "toxic").unionByName(spark.createDataFrame([(None, 1), (9999, 1), (1003, None)], "doc_id long, toxic int"))
    docs = docs.withColumn("score", F.lit("old")).withColumn("label", F.lit(9))
    got = sorted(((r["doc_id"] or 0, r["predicted"]) for r in score_toxicity(docs, lab).collect() if (r["doc_id"] or 0) < 1000))
    assert got == [(0, 1), (1, 1), (2, 0), (2, 0), (3, 0), (4, 0), (6, 0)]
    for none in (lab.limit(0), lab.filter("toxic = 0")):
        out = score_toxicity(docs, none).collect()
        assert len({r["score"] for r in out}) == 1 and 0 <= out[0]["score"] <= 1
    assert score_toxicity(docs.limit(0), lab).count() == 0


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.1"
    out = registry.op5_toxicity(spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").filter("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    # some texts of these tables are labelled toxic without any toxic word
    assert n.get((1, 1), 0) >= 0.85 * (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0
    assert n.get((0, 1), 0) <= 0.02 * n[0, 0]
