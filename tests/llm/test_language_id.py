import numpy as np
from pyspark.sql import functions as F

from tessera.llm import registry
from tessera.llm.language_id import GRAMS, counts_of, fit, identify, keep_identified

ROWS = [(i, f"the cat and the dog number{i}", "en") for i in range(20)] + [(100 + i, f"der hund und die katze nummer{i}", "de") for i in range(20)]


def grams(text):
    out = []
    data = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in b" " + text.encode() + b" ")
    for n in GRAMS:
        for i in range(len(data) - n + 1):
            g = data[i : i + n]
            if (n > 2 and 32 not in g[1:-1]) or (n == 2 and g[1] != 32):
                out.append(g)
    return out


def test_counts_match_plain_sets(spark):
    """A filter without false positives counts what plain sets count."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    model = fit(df, "text", "lang", bits=22, least_share=0.0)
    sets = {x: {g for _, t, at in ROWS if at == x for g in grams(t)} for x in ("de", "en")}
    texts = ["the hund", "", "x", "katze, 12 dog!", "ééé", "a" * 700_000, "und"]
    got, total = counts_of([t.encode() for t in texts], model)
    for k, t in enumerate(texts):
        mine = grams(t)
        assert total[k] == len(mine)
        assert np.allclose(got[k], [sum(g in sets[x] for g in mine) for x in ("de", "en")], atol=0.5 + 1e-3 * len(mine))


def test_decisions_match_plain_counts(spark):
    """Predictions and scores follow from the counts of the n-grams that each language contains."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    texts = ["the hund", "katze", "dog dog", "number1 und der the", "zzz"]
    sets = {x: {g for _, t, at in ROWS if at == x for g in grams(t)} for x in ("de", "en")}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in identify(docs, df, bits=24, least_share=0.0).collect():
        n = {x: sum(g in sets[x] for g in grams(r["text"])) for x in sets}
        best = max(sorted(n), key=n.get) if any(n.values()) else "de"
        assert r["lang_pred"] == best and abs(r["score"] - n[best] / max(1, sum(n.values()))) < 0.01


def test_defined_results(spark):
    df = spark.createDataFrame([*ROWS, (300, None, "en"), (301, "", None), (302, "12 !?", "de"), (303, "qqq", None), (None, "the dog", None)], "doc_id long, text string, lang string")
    df = df.withColumn("score", F.lit("s")).withColumn("lang_pred", F.lit(1))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, df).collect()}
    assert got[300] == got[301] == got[302] == ("und", 0.0) and got[303][1] == 0.0 and got[None][0] == "en"
    assert all(got[i][0] == x for i, _, x in ROWS) and all(0 <= s <= 1 for _, s in got.values())
    kept = keep_identified(df, df)
    assert kept.columns == df.columns and kept.count() == len(ROWS) + 2 and kept.filter("score = 's'").count() == len(ROWS) + 2
    assert {r["lang_pred"] for r in identify(df, df.limit(0)).collect()} == {"und"}
    assert identify(df.limit(0), df).count() == 0


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    out = registry.op4_language_id(spark, root).join(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang"), "doc_id")
    seen = out.filter("held_out AND lang IS NOT NULL")
    assert seen.filter("lang = lang_pred").count() >= 0.97 * seen.count() > 0
