import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.mixture import apply_mix, fit_rates, mix

VOCAB = {"a": ["ant", "ask", "all"], "b": ["bee", "bit", "bag"], "c": ["cat", "cup", "cot"]}


def corpus(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        d = "a" if i % 10 < 6 else "b" if i % 10 < 9 else "c"
        text = " ".join(rng.choice(VOCAB[d] + ["the"]) for _ in range(rng.randint(1, 60)))
        rows.append((i, text, None if i % 7 == 0 else d))
    rows += [(700, None, "a"), (701, "", None), (702, "The.", None), (None, "bee", "b"), (5, "cat cat", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_rates_reach_the_targets_and_labels_are_found(spark):
    docs = corpus(spark).withColumn("tokens", F.lit("x")).withColumn("rate", F.lit(0))
    want = {"a": 0.2, "b": 0.5, "c": 0.3}
    out = mix(docs, want).cache()
    assert out.count() == 604 and out.filter("rate < 0").count() == 0
    total = out.agg(F.sum("tokens")).first()[0]
    got = {r[0]: r[1] / total for r in out.groupBy("domain").agg(F.sum(F.expr("rate * tokens"))).collect()}
    assert all(abs(got[d] - want[d]) < 0.02 for d in want), got
    seen = out.join(docs.select(F.col("doc_id").alias("i"), "lang"), F.expr("doc_id = i")).filter("lang IS NOT NULL AND tokens > 5")
    assert seen.filter("domain = lang").count() > 0.97 * seen.count()
    again = mix(docs.repartition(7), want)
    assert sorted((str(r["doc_id"]), r["copies"]) for r in again.collect()) == sorted((str(r["doc_id"]), r["copies"]) for r in out.collect())
    assert mix(docs.limit(0)).count() == 0
    none = mix(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.filter("rate = 1.0 AND domain IS NULL").count() == 604


def test_projected_gradient_matches_a_brute_force_solver(spark):
    rng = random.Random(2)
    soft = []
    for i in range(40):
        p = [rng.random() ** 3 for _ in range(3)]
        soft.append((i, rng.randint(1, 50), *[x / sum(p) for x in p]))
    total = sum(s[1] for s in soft)
    shares = [0.7, 0.25, 0.05]
    df = spark.createDataFrame(soft, "doc_id long, tokens long, p0 double, p1 double, p2 double")
    got = {r["doc_id"]: r["rate"] for r in fit_rates(df, shares, total, 1e-5, 400, 25).collect()}
    miss = max(abs(sum(got[s[0]] * s[1] * s[2 + k] for s in soft) / total - shares[k]) for k in range(3))
    r, low = [1.0] * 40, 1.0
    for _ in range(20000):
        off = [sum(r[j] * soft[j][1] * soft[j][2 + k] for j in range(40)) / total - shares[k] for k in range(3)]
        low = max(map(abs, off))
        if low < 1e-5:
            break
        r = [max(0.0, r[j] - sum(off[k] * soft[j][2 + k] for k in range(3))) for j in range(40)]
    assert miss <= 1e-5 and low <= 1e-5 and min(got.values()) >= 0


def test_apply(spark):
    docs = corpus(spark)
    mixed = docs.select("doc_id").distinct().withColumn("copies", F.expr("CASE WHEN doc_id % 3 = 0 THEN 0 ELSE coalesce(doc_id % 3, 1) END").cast("long"))
    out = apply_mix(docs, mixed)
    assert out.columns == docs.columns
    assert out.count() == sum(1 if r["doc_id"] is None else r["doc_id"] % 3 for r in docs.collect())


def one_hot(spark, sizes):
    rows = [(i, 100, *[1.0 if k == d else 0.0 for k in range(len(sizes))]) for d, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, tokens long, " + ", ".join(f"p{k} double" for k in range(len(sizes))))


@pytest.mark.parametrize("sizes", [(1994, 4, 2), (9000, 999, 1)])
def test_rare_domains_reach_their_targets_within_the_production_steps(spark, sizes):
    total = 100.0 * sum(sizes)
    raw = [(n / sum(sizes)) ** 0.7 for n in sizes]
    shares = [x / sum(raw) for x in raw]
    out = fit_rates(one_hot(spark, sizes), shares, total, 1e-4, 60, 4)
    got = out.agg(*[F.sum(F.expr(f"rate * tokens * p{k}")) for k in range(len(sizes))]).first()
    assert all(abs(got[k] / total / shares[k] - 1) <= 1e-4 for k in range(len(sizes))), (list(got), shares)


def test_targets_out_of_reach_raise(spark):
    soft = spark.createDataFrame([(i, 10, 0.6, 0.4) for i in range(20)], "doc_id long, tokens long, p0 double, p1 double")
    with pytest.raises(ValueError, match="miss their targets"):
        fit_rates(soft, [0.1, 0.9], 200.0, 1e-4, 60, 4)


def test_written_shares_meet_the_targets_when_every_document_stays(spark):
    docs = corpus(spark).filter("doc_id IS NOT NULL")
    want = {"a": 0.3, "b": 0.4, "c": 0.3}
    out = mix(docs, want, min_copies=1).cache()
    assert out.filter("copies < 1 OR rate < 1").count() == 0
    p = out.groupBy("domain").agg(F.sum(F.expr("copies * tokens")).alias("n"), F.sum(F.expr("rate * tokens")).alias("r")).collect()
    for c, near in (("n", 0.03), ("r", 0.01)):
        total = sum(x[c] for x in p)
        assert all(abs(x[c] / total - want[x["domain"]]) < near for x in p), p
    with pytest.raises(ValueError):
        mix(docs, {"a": 0.0, "b": 1.0}, min_copies=1, max_steps=5)


def test_texts_that_do_not_tell_domains_apart_give_the_nearest_fit(spark):
    same = spark.createDataFrame([(i, "one and the same text", "a" if i % 4 else "b") for i in range(20)], "doc_id long, text string, lang string")
    out = mix(same).collect()
    assert len(out) == 20 and {r["copies"] for r in out} == {1} and all(abs(r["rate"] - 1) < 1e-6 and r["target_miss"] < 1e-4 for r in out)
    assert {r["copies"] for r in mix(same, min_copies=1).collect()} == {1}
    with pytest.raises(ValueError):
        mix(same, {"a": 0.2, "b": 0.8}, max_steps=30)
    some = same.unionByName(spark.createDataFrame([(100 + i, "another kind of words", "c") for i in range(5)], same.schema))
    rows = mix(some).collect()
    assert len(rows) == 25 and max(r["target_miss"] for r in rows) < 1e-3
    assert min(r["rate"] for r in rows if r["doc_id"] >= 100) > 1 > max(r["rate"] for r in rows if r["doc_id"] < 100)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "ant ask all " * 200_000, "a"), (2, "bee bit", "b"), (3, "ant", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["tokens"] for r in mix(docs).collect()} == {1: 600_000, 2: 2, 3: 1}
