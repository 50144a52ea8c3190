from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as overlapping
from tests.llm.test_jaccard_join import brute as classes
from tests.llm.test_token_table import brute as tokens


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_each_stage_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", None, 0), (10_001, "", None, "s", 0), (10_002, "12 34", "en", "s", 5), (10_003, docs.first()["text"], None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    start = rows(docs)
    kept = corpus_pipeline.language_id(spark, docs, sf).cache()
    assert kept.columns == docs.columns
    assert sorted(rows(kept)) == sorted(r for r in start if r[0] not in (10_000, 10_001, 10_002))
    one = corpus_pipeline.near_duplicates(spark, kept, sf).cache()
    want = sorted(d for d, n, c in classes(rows(kept)) if d == c)
    assert sorted(d for d, _ in rows(one)) == want and 10_003 not in want and len(want) < kept.count() - 1
    clean = corpus_pipeline.decontamination(spark, one, sf).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = overlapping(rows(one), items)
    assert sorted(d for d, _ in rows(clean)) == sorted(d for d, x in found if not x) and any(x for _, x in found)
    mixed = corpus_pipeline.mixture(spark, clean, sf).cache()
    assert set(rows(mixed)) == set(rows(clean)) and mixed.count() > clean.count() and mixed.columns == docs.columns
    out = sorted((tuple(r) for r in corpus_pipeline.token_output(spark, mixed, sf).collect()), key=lambda r: r[1])
    assert out == tokens(rows(mixed))
    langs = Counter(r["lang"] for r in clean.collect()), Counter(r["lang"] for r in mixed.collect())
    assert langs[1]["es"] / langs[0]["es"] > langs[1]["en"] / langs[0]["en"] >= 1


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, sf):
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    near = a.replace("w39", "x")
    start = [(1, a), (5, a), (5, b), (5, b), (6, near), (None, b + " more"), (None, None), (7, ""), (7, ""), (8, "few words"), (8, "few words"), (9, near), (8, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(start)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    left = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert left.columns == docs.columns
    assert sorted(rows(left), key=str) == sorted([(1, a), (None, b + " more"), (None, None), (7, ""), (7, ""), (8, "few words")], key=str)
    unlike = docs.filter("n_chars IN (0, 1, 2)")
    assert sorted(rows(corpus_pipeline.near_duplicates(spark, unlike, sf))) == [(1, a), (5, b)]


@pytest.mark.parametrize("stage", [corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.token_output])
def test_stages_send_texts_to_python_in_small_batches(spark, sf, stage):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(5), sf)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    long = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("some words "), 400).alias("text"))
    assert max(r["n"] for r in long.mapInArrow(sizes, "n long").collect()) <= 9 << 20


def test_run_applies_all_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixture", "token_output"]
