import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.linear import fit_ordinal, sigmoid
from tessera.llm.quality import rate_quality


def test_ordinal_fit_recovers_known_thresholds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    w, t = np.array([1.5, -1.0, 0.5]), np.array([-1.0, 0.5, 2.0])
    y = (rng.random(4000)[:, None] > sigmoid(t[None] - (x @ w)[:, None])).sum(1)
    got_w, got_t = fit_ordinal(np.arange(0, 12001, 3), np.tile([0, 1, 2], 4000), x.ravel(), y, 3, 4, l2=0.0, steps=800, rate=0.05)
    assert np.allclose(got_w, w, atol=0.15) and np.allclose(got_t, t, atol=0.15) and (np.diff(got_t) > 0).all()


def test_grades_in_order_and_defined_results(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("sea sun ring ship rain road".split()) for _ in range(n))
    make = {1: lambda: say(30).upper() + "!!", 2: lambda: say(30).replace(" ", " | "), 5: lambda: say(30).capitalize() + "."}
    rows = [(i, make[g](), g) for i, g in enumerate(rng.choice([1, 2, 5]) for _ in range(300))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "Sea."), (902, "sea " * 60_000), (3, rows[3][1])], "doc_id long, text string")
    docs = docs.withColumn("tail", F.lit("x")).withColumn("label", F.lit(0))
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 1), (5000, 2), (1, None)], "doc_id long, quality int")
    out = rate_quality(docs, labels, tail_grade=2)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 305 and len(got) == 304
    mean = {g: np.mean([got[i]["expected_grade"] for i, _, x in rows if x == g]) for g in (1, 2, 5)}
    assert mean[1] < 0.5 < mean[2] < 1.5 < mean[5] <= 2
    assert all(got[i]["selected"] == (g == 5) for i, _, g in rows)
    for none in (labels.limit(0), labels.filter("quality = 2")):
        assert {(r["expected_grade"], r["tail"], r["selected"]) for r in rate_quality(docs, none).collect()} == {(0.0, 1.0, True)}
    assert rate_quality(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) > 0
    out = rate_quality(docs, labels.filter(seen)).join(labels, "doc_id").filter(~seen)
    n = {(r["quality"], r["selected"]): r["count"] for r in out.groupBy("quality", "selected").count().collect()}
    assert n.get((1, True), 0) >= 0.97 * sum(v for k, v in n.items() if k[0] == 1)
    assert n.get((0, False), 0) >= 0.85 * sum(v for k, v in n.items() if k[0] == 0)
