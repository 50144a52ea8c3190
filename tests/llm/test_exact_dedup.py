import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import build_index, directory, exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    low = lambda i: (i is not None, i or 0)
    return sorted(
        ((i, keep := max(groups[t or ""], key=low), len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows),
        key=str,
    )


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "x" * 50_000), (7, "a"), (8, "é"), (9, "e"), (10, "b"), (10, "b"), (None, "q"), (11, "A")]


@pytest.mark.parametrize("key", [None, "mod", "one"])
def test_matches_brute_force_also_when_keys_collide(spark, key):
    weak = {None: None, "mod": F.pmod(F.xxhash64("text"), F.lit(3)), "one": F.lit(7)}[key]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = exact_dedup(docs, key=weak, bucket_capacity=2, compare_chunk=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_hot_group_extra_columns_and_empty(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("text"), F.lit(1).alias("key"), F.lit(2).alias("keep_id")
    )
    got = exact_dedup(docs, compare_chunk=64)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got.filter("kept").count() == 1001 and got.count() == 3000
    assert got.filter("group_size = 2000").select("keep_id").distinct().collect()[0][0] == 2999
    assert exact_dedup(docs.limit(0)).count() == 0


def test_directory_covers_every_slot_once_and_splits_overfull_buckets(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("key"))
    slots = directory(rows.withColumn("n", F.lit(1)), 300).collect()
    depth = slots[0]["global_depth"]
    assert sorted(r["slot"] for r in slots) == list(range(2**depth))
    assert len({r["local_depth"] for r in slots}) >= 1
    sizes = build_index(rows, 300)[0].groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 300 and sum(r["count"] for r in sizes) == 4000
    skew = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").alias("key"))  # all in one slot
    assert directory(skew, 300).filter("overfull").count() == 1
