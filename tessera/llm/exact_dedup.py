"""Exact duplicates by an extendible-hash index on shared files.

The index has one entry for each distinct 64-bit key of a text. A directory over the leading key bits
doubles until no bucket holds more than ``bucket_capacity`` entries; a bucket that is small enough
earlier keeps its shorter prefix, and several directory slots point to it. Entries are written to
the shared folder by key range. The directory then routes every row to its bucket, and rows and entries of a range of buckets
and keys meet in the task that owns it: there each row finds the entry of its key and is compared byte
by byte with the text of the entry's owner. Copies of one text have one
key, so a hot group does not fill a bucket: it is dealt to parts, each with the owner's text. Texts that share a key but differ go down the chain: they are indexed again
among themselves, until none is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.scratch import materialize

#: The directory has at most ``2**MAX_DEPTH`` slots, which bounds its broadcast; buckets that are too full then are chained.
MAX_DEPTH = 18
#: Groups that are dealt to parts, at most.
MOST_SPLIT = 100_000


def directory(entries: DataFrame, bucket_capacity: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Directory slots ``(slot, global_depth, local_depth, bucket, overfull)`` over the leading bits of ``key``.

    ``bucket`` is the first slot of a bucket. A bucket that is still too full at the greatest depth is
    marked ``overfull`` and keeps all its entries (its pages are chained). The number of slots follows
    the number of entries divided by the capacity.
    """
    n = entries.count()
    depth = min(max_depth, max(1, math.ceil(math.log2(max(1, n / bucket_capacity))) + 4))
    fine = entries.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("slot")).agg(F.count("*").alias("n"))
    levels = (
        fine.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
        .groupBy("d", F.expr(f"shiftright(slot, {depth} - d)").alias("prefix"))
        .agg(F.sum("n").alias("n"))
    )
    full = levels.filter((F.col("n") > bucket_capacity) & (F.col("d") < depth)).select(
        (F.col("d") + 1).alias("d"), F.col("prefix").alias("parent"), F.lit(True).alias("parent_full")
    )
    buckets = (
        levels.withColumn("parent", F.shiftright("prefix", 1))
        .join(full, ["d", "parent"], "left")
        .filter(((F.col("d") == 0) | F.col("parent_full")) & ((F.col("n") <= bucket_capacity) | (F.col("d") == depth)))
    )
    first = F.expr(f"shiftleft(prefix, {depth} - d)")
    return buckets.select(
        F.explode(F.sequence(first, F.expr(f"shiftleft(prefix + 1, {depth} - d) - 1"))).alias("slot"),
        F.lit(depth).alias("global_depth"),
        F.col("d").alias("local_depth"),
        first.alias("bucket"),
        (F.col("n") > bucket_capacity).alias("overfull"),
    )


def build_index(rows: DataFrame, bucket_capacity: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Entries ``(bucket, local_depth, key, n, owner_id)`` of ``rows (doc_id, key)`` on shared files by key range, the directory's slots and its depth."""
    entries = materialize(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("owner_id")), "eh-entries")
    slots = materialize(directory(entries, bucket_capacity), "eh-directory")
    depth = slots.select(F.max("global_depth")).first()[0] or 1
    owned = route(entries, slots, depth).select("bucket", "local_depth", "key", "n", "owner_id").repartitionByRange("bucket", "key")
    return materialize(owned.sortWithinPartitions("bucket", "key"), "eh-index"), slots, depth


def route(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Adds ``bucket, local_depth`` to ``rows (key, ...)``: the directory's slot of the leading ``depth`` bits of the key."""
    small = F.broadcast(slots.select("slot", "bucket", "local_depth"))  # 2**MAX_DEPTH slots at most
    return rows.withColumn("slot", F.shiftrightunsigned("key", 64 - depth)).join(small, "slot").drop("slot")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    key: Column | None = None,
    bucket_capacity: int = 1 << 16,
    compare_chunk: int = 512,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Two texts are equal when their UTF-8 bytes are; of equal texts the row with the largest id stays.
    A null text counts as empty. Rows that repeat both an id and its text are one document: each of them
    is counted in ``group_size`` and carries the same decision. A null id sorts below all others. Other
    columns of ``docs`` are ignored, whatever their names; an empty table gives no rows.

    key: the 64-bit key of column ``text`` (tests pass a weak one). compare_chunk: members that are
    compared with one copy of their owner's text, so that a hot group spreads over tasks (more where groups are very many).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    key = F.xxhash64("text") if key is None else key
    base = base.withColumn("key", key.cast("long"))
    level, done = base, []
    while True:
        met = _compare(level, *build_index(level.select("doc_id", "key"), bucket_capacity), compare_chunk)
        differ = met.filter(~F.col("same"))
        last = differ.isEmpty()
        if last:
            size = F.col("n")
        else:
            less = differ.groupBy("key").agg(F.count("*").alias("less"))
            size = F.col("n") - F.coalesce("less", F.lit(0))
            met = met.join(less, "key", "left")
        done.append(met.filter("same").select("doc_id", F.col("owner_id").alias("keep_id"), size.alias("group_size"), "text_sha256"))
        if last:
            break
        level = materialize(_chain(level, differ.select("doc_id", "key", "text_sha256").distinct()), "eh-chain")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def _chain(level: DataFrame, chained: DataFrame) -> DataFrame:
    """The rows of ``level`` that differ from their owner."""
    c = chained.select(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key"), F.col("text_sha256").alias("c_sha"))
    met = F.expr("key = c_key AND doc_id <=> c_id") & (F.sha2(F.col("text"), 256) == F.col("c_sha"))
    return level.join(c, met, "left_semi")


def _compare(level: DataFrame, index: DataFrame, slots: DataFrame, depth: int, chunk: int) -> DataFrame:
    """``doc_id, key, n, owner_id, same, text_sha256``: the bytes of every row against those of its key's owner.

    Rows and entries are dealt by range of bucket, key and part; the members of a group of more than ``chunk`` go to
    parts of it, and the owner's rows to each of them. In order of a part come the entry, the owner's text and the
    other members, so that a row looks back only.
    """
    rows = index.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("n") / F.lit(max(chunk, rows // MOST_SPLIT)))
    entries = index.withColumn("parts", parts.cast("int"))
    split = F.broadcast(entries.filter("parts > 1").select("bucket", "key", "parts", F.col("owner_id").alias("split_id")))  # MOST_SPLIT rows at most
    placed = route(level, slots, depth).join(split, ["bucket", "key"], "left")
    own = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.coalesce("parts", F.lit(1))).cast("int")
    every = F.expr("CASE WHEN parts > 1 AND doc_id <=> split_id THEN sequence(0, parts - 1) ELSE array(own) END")
    members = placed.withColumn("own", own).withColumn("part", F.explode(every)).select(
        "bucket", "key", "part", F.lit(1).alias("kind"), "doc_id", "text", (F.col("part") == F.col("own")).alias("mine"), F.lit(None).cast("long").alias("n")
    )
    heads = entries.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "bucket", "key", "part", F.lit(0).alias("kind"), F.col("owner_id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("mine"), "n"
    )
    owned = members.unionByName(heads).repartitionByRange("bucket", "key", "part")
    w = Window.partitionBy("bucket", "key", "part").orderBy("kind", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    met = owned.select(
        "doc_id", "key", "mine", "text", F.first("n").over(w).alias("n"), F.first("doc_id").over(w).alias("owner_id"), F.first("text", ignorenulls=True).over(w).alias("owner_text")
    ).filter("mine")
    return materialize(met.select("doc_id", "key", "n", "owner_id", (F.col("text") == F.col("owner_text")).alias("same"), F.sha2("text", 256).alias("text_sha256")), "eh-compared")
