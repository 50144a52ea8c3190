"""Near duplicates by 64-bit SimHash: all fingerprints within a few bits of each other, by deletion variants.

1. A fingerprint is taken of the word shingles of each whole text, in one pass; equal fingerprints are one node from here on.
2. Three differing bits over two segments leave a segment that differs by one bit at most. So a fingerprint is cut into two
   segments of 32 bits, not into four that have to be equal, and each segment enters the index once for each of its bits,
   with that bit deleted: 64 entries in all. Two segments that differ by one bit at most have a variant in common.
3. Entries meet by equality of their variant, and are verified by all 64 bits. A variant that many share gives a forest
   of its links, not all of them.
4. The fingerprints of a variant that more than ``crowd`` of them share agree in one segment but for the deleted bit, so their differences are
   those of the other segment, which is cut into two in the same way, and so on: after three cuts at most 2,048
   fingerprints can agree. No list is read as a whole by one task, and none is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.crowds import join_counted
from tessera.plans.scratch import materialize

#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Up to this many entries of a variant all pairs are tested in one sweep; beyond, a forest is grown.
SWEEP = 32


def shingle_hashes(text: bytes, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of ``text``, repeats included, block by block; of the whole sequence if it has fewer than ``size`` words."""
    at, words, whole = 0, [], True
    while at < len(text):
        end = SPACE.search(text, at + BLOCK)
        end = end.start() if end else len(text)
        words = words[-(size - 1) :] * (size > 1) if not whole else words
        words += text[at:end].lower().split()
        at = end
        if len(words) >= size:
            whole = False
            ends = np.cumsum([len(w) + 1 for w in words])
            joined = b" ".join(words)
            begin = [0, *ends[: len(words) - size].tolist()]
            yield np.array([xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(begin, ends[size - 1 :].tolist(), strict=True)], np.uint64)
    if whole and words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the hashes of the shingles; 0 without words."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, size, seed):
        total += len(h)
        for k in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """``doc_id, fp`` of each row of ``docs (doc_id, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint((t.as_py() or "").encode(), size, seed) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def variants(entries: DataFrame) -> DataFrame:
    """The deletion variants of ``entries (fp, key, low, width)``, as ``key, fp, low, width`` of the segment that is left.

    The ``width`` bits from ``low`` are cut into two segments; ``key`` names the segment, its deleted bit and the others.
    """
    cut = entries.withColumn("j", F.explode(F.expr("sequence(0, width - 1)"))).withColumn("half", F.expr("width div 2"))
    segment = "shiftrightunsigned(fp, low + (j div half) * half) & (shiftleft(1L, half) - 1L) & ~shiftleft(1L, j % half)"
    return cut.select(
        F.expr(f"xxhash64(key, j, {segment})").alias("key"), "fp", F.expr("CAST(low + (1 - j div half) * half AS INT)").alias("low"), F.col("half").cast("int").alias("width")
    )


def _forest(fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of the fingerprints that are near each other."""
    left = fp
    while len(left):
        heap, left = [left[0]], left[1:]
        while heap and len(left):
            x = heap.pop()
            near = np.bitwise_count(left ^ x) <= bits
            found, left = left[near], left[~near]
            yield np.full(len(found), x), found
            heap += list(found)


def _links(key: np.ndarray, fp: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among entries with one key; equal keys lie side by side."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.r_[begin, len(key)])
    end = np.repeat(np.where(size <= SWEEP, begin + size, 0), size)
    d, at = 1, np.arange(len(key))
    while len(at := at[at + d < end[at]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= bits]
        yield fp[near], fp[near + d]
        d += 1
    for a, n in zip(begin[size > SWEEP].tolist(), size[size > SWEEP].tolist(), strict=True):
        yield from _forest(fp[a : a + n], bits)


def match(entries: DataFrame, bits: int, crowd: int) -> DataFrame:
    """``a, b`` of links among ``entries (key, fp, low, width)`` of one key; entries of crowded keys as ``a, NULL, key, low, width``.

    A task holds at most one batch and ``crowd`` entries of one key.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", "low", "width"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        over = None  # the crowded key that is passed on

        def done(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in _links(key, fp, bits):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *(pa.nulls(len(a), t) for t in types[2:])], names)

        held = [np.empty(0, t) for t in (np.int64, np.uint64, np.int32, np.int32)]
        for batch in batches:
            now = [np.asarray(batch.column(c)) for c in ("key", "fp", "low", "width")]
            now[1] = now[1].view(np.uint64)
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            key = now[0]
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[begin, len(key)])
            # the segment that is left has four bits at the end: at most 256 fingerprints, however they are cut
            pass_on = np.repeat(((size > crowd) | (key[begin] == over if over is not None else False)) & (now[3][begin] > 4), size)
            if pass_on.any():
                out = [x[pass_on] for x in now]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[1].view(np.int64)), pa.nulls(len(out[0]), pa.int64()), pa.array(out[0]), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names
                )
            over = key[-1] if pass_on[-1] else None
            last = (key == key[-1]) & ~pass_on
            yield from done(key[~last & ~pass_on], now[1][~last & ~pass_on])
            held = [x[last] for x in now]
        yield from done(held[0], held[1])

    placed = entries.repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(run, "a long, b long, key long, low int, width int")


def near_fingerprints(nodes: DataFrame, bits: int = 3, crowd: int = 4096) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``nodes (fp)`` that differ by at most ``bits`` bits, enough of them to connect all that are linked."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments find at most three differing bits")
    entries = nodes.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("low"), F.lit(64).alias("width"))
    links = None
    while True:
        met = materialize(match(variants(entries), bits, crowd), "sim-links")
        found = met.filter("b IS NOT NULL").select("a", "b")
        links = found if links is None else links.unionByName(found)
        crowded = met.filter("b IS NULL")
        if crowded.isEmpty():
            return links.distinct()
        entries = crowded.select(F.col("a").alias("fp"), "key", "low", "width").distinct()


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 3, seed: int = 42, crowd: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint, component_id``.

    Words are lower-cased (A-Z) runs without white space. A bit of the fingerprint is set if it is set in over half of the XXH64 hashes
    of the ``size``-word shingles, repeats included; a text of fewer words has its whole sequence as one shingle; one without words, or
    null, has the fingerprint zero and links as any other. Fingerprints link at ``bits`` (3 at most) or fewer differing bits; ``component_id`` is the least
    id that links reach. Each row is a document of its own, also where ids repeat; null ids are never the least, and a component of
    null ids has a null one. Other columns are ignored; an empty table gives no rows.

    crowd: fingerprints of one index key that are compared in one task; the keys of more are cut further.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(fingerprints(base, size, seed), "sim-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "sim-nodes")
    roots = components(near_fingerprints(nodes, bits, crowd)).withColumnRenamed("node", "fp")
    placed = materialize(nodes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "sim-placed")
    low = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"), F.sum("n").alias("docs"))
    low = materialize(low, "sim-roots")
    total = low.agg(F.sum("m").alias("m"), F.sum("docs").alias("docs")).first()
    final = join_counted(placed.select("fp", "n", "root"), low.drop("docs"), "root", "m", total["m"] or 0).select("fp", "n", "component_id")
    final = materialize(final, "sim-classes")
    found = join_counted(prints, final, "fp", "n", total["docs"] or 0)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
