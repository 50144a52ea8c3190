"""Exact similarity classes of word-shingle sets, with skipping by set relations.

1. Every document becomes its set of shingle hashes; documents with one set are one set from here on.
2. Sets that share a minimum under one of a few hash functions are compared with one of them, their leader, and with
   the next one in order of further minima. A group of any size costs two comparisons a member. Sets at ``similarity``
   or more are joined to components. A set at least half of which its leader shares keeps its difference from it: the
   shingles that only one of both has.
3. Answers of sets with one leader follow from their differences: two sets differ exactly where their differences
   from the leader do. Two sets of different components can't both be near the leader, so that their differences have a shingle in
   common, and most often several; differences are matched by index lists of their own, rarest shingle first, and no
   set is read again. In a first round each entry of a list has its best partner tested only; the second one tests all
   pairs of the components that are left.
4. Prefix filter for all other pairs: a set enters the index lists of its rarest shingles. Lists are sorted by set size and position of the
   shingle in its set; a whole block of one size is skipped when the sizes or the positions leave too few
   shingles, and pairs of one component or one leader need no answer any more. Sets that have a neighbour from step 2 also carry a parity
   bitmap, whose difference bounds the overlap from above. The remaining pairs are compared as a whole.

The order of shingles comes from a count sketch over all documents; it decides how long lists are, never
which pairs are found. Hashes have 64 bits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.textnum import BASE, mix, shingles
from tessera.plans.batches import small_batches
from tessera.plans.scratch import materialize, new_dir

SEGMENT = 1 << 14
ODD = [np.uint64((int(BASE) * (2 * k + 3)) & (1 << 64) - 1 | 1) for k in range(64)]


def profile(docs: DataFrame, size: int, hashes: int, sketch_bits: int) -> DataFrame:
    """``doc_id, th, n, set_id, mins`` for each row of ``docs (doc_id, text, th)``, and rows ``seg, counts`` of the count sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << sketch_bits, np.int64)
        low = np.uint64((1 << sketch_bits) - 1)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("set_id", pa.int64()), ("mins", pa.list_(pa.int64())), ("seg", pa.int32()), ("counts", pa.binary())]
        )
        for batch in batches:
            n, ids, mins = [], [], []
            with np.errstate(over="ignore"):
                for s in shingles([t.encode() for t in batch.column("text").to_pylist()], size):
                    n.append(len(s))
                    ids.append((mix(s * ODD[-1]).sum() + np.uint64(len(s))).astype(np.uint64).view(np.int64))
                    mins.append([int((mix(s * ODD[k])).min().view(np.int64)) for k in range(hashes)] if len(s) else [])
                    np.add.at(sketch, (s & low).astype(np.int64), 1)
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), pa.array(mins, pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                schema=schema,
            )
        parts = [(g, sketch[g * SEGMENT : (g + 1) * SEGMENT]) for g in range(max(1, len(sketch) // SEGMENT))]
        parts = [(g, x) for g, x in parts if x.any()]
        yield pa.RecordBatch.from_pylist([{"seg": g, "counts": zlib.compress(x.astype("<u4").tobytes(), 1)} for g, x in parts], schema=schema)

    return docs.mapInArrow(run, "doc_id long, th long, n int, set_id long, mins array<long>, seg int, counts binary")


def sketch_levels(profiled: DataFrame, sketch_bits: int) -> np.ndarray:
    """The base-2 logarithm of each sketch slot's count: ``2 ** sketch_bits`` bytes, however many tasks counted."""
    segments = max(1, (1 << sketch_bits) // SEGMENT)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(zlib.decompress(row["counts"]), "<u4").astype(np.int64)
                sums[row["seg"]] = sums[row["seg"]] + x if row["seg"] in sums else x
        level = {g: np.log2(np.maximum(x, 1)).astype(np.uint8).tobytes() for g, x in sums.items()}
        yield pa.RecordBatch.from_pylist([{"seg": g, "level": x} for g, x in level.items()], schema=pa.schema([("seg", pa.int32()), ("level", pa.binary())]))

    rows = profiled.filter("seg IS NOT NULL").select("seg", "counts").repartition(min(segments, 64), "seg").mapInArrow(total, "seg int, level binary")
    out = np.zeros(1 << sketch_bits, np.uint8)
    for r in rows.collect():
        part = np.frombuffer(r["level"], np.uint8)
        out[r["seg"] * SEGMENT : r["seg"] * SEGMENT + len(part)] = part
    return out


def overlaps(pairs: DataFrame, texts: DataFrame, size: int, levels: np.ndarray | None = None, chunk: int = 1024) -> DataFrame:
    """``x, y, nx, ny, inter`` for ``pairs (x, y, more columns)``, from the whole texts. ``texts`` is bucketed by ``sid``, so it isn't shuffled.

    The pairs of a ``y`` that has more than ``chunk`` of them are dealt to parts, each with the text of ``y``. With ``levels``, rows whose
    union is at most twice their overlap also get ``diff``: the shingles of ``x`` only, rare ones first, then those of ``y`` only.
    """
    kept = [c for c in pairs.columns if c not in ("x", "y")]
    left = texts.select(F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("text").alias("tx"))
    right = texts.select(F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("text").alias("ty"))
    often = pairs.groupBy("y").agg(F.count("*").alias("m")).filter(F.col("m") > chunk).select("y", F.ceil(F.col("m") / chunk).cast("int").alias("parts"))
    often = F.broadcast(often)  # at most one row for `chunk` pairs
    with_x = pairs.join(often, "y", "left").join(left, "x")
    shape = ["x", "y", *kept, "nx", "tx", "ny", "ty"]
    few = with_x.filter("parts IS NULL").join(right, "y").select(*shape)
    dealt = right.join(often, "y").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    many = with_x.filter("parts IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).join(dealt, ["y", "part"]).select(*shape)
    shared = pairs.sparkSession.sparkContext.broadcast(levels) if levels is not None else None  # 2 ** sketch_bits bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] = (-1, np.empty(0))
        for batch in batches:
            ys, ty = batch.column("y").to_pylist(), batch.column("ty")
            inter, diffs = [], []
            for k, s in enumerate(shingles([t.encode() for t in batch.column("tx").to_pylist()], size)):
                if ys[k] != last[0]:
                    last = ys[k], next(shingles([ty[k].as_py().encode()], size))
                at = np.minimum(np.searchsorted(last[1], s), len(last[1]) - 1)
                same = last[1][at] == s
                inter.append(int(same.sum()))
                if shared is not None:
                    near = len(s) + len(last[1]) <= 3 * inter[-1]
                    diffs.append(_difference(s[~same], np.setdiff1d(last[1], s, assume_unique=True), shared.value) if near else None)
            cols = [*(batch.column(c) for c in ("x", "y", *kept, "nx", "ny")), pa.array(inter, pa.int32())]
            if shared is not None:
                cols.append(pa.array(diffs, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["x", "y", *kept, "nx", "ny", "inter"] + ["diff"] * (levels is not None)
    fields = "x long, y long, " + "".join(f"{c} {pairs.schema[c].dataType.simpleString()}, " for c in kept) + "nx int, ny int, inter int" + ", diff array<long>" * (levels is not None)
    return few.unionByName(many).mapInArrow(run, fields)


def _rank(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Sorting key of shingles: rare ones first."""
    low = np.uint64(len(level) - 1)
    return (level[(s & low).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))


def _difference(more: np.ndarray, less: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Shingles that only the set has, then those that only its leader has, each rare ones first."""
    parts = [x[np.argsort(_rank(x, level), kind="stable")] for x in (more, less)]
    return np.concatenate(parts).astype(np.uint64).view(np.int64)


DIFF_WORDS = 4  # 64-bit words of the parity bitmap of a difference


def difference_pairs(
    roots: np.ndarray, n: np.ndarray, d: np.ndarray, p: np.ndarray, bits: np.ndarray, block: np.ndarray, share: tuple[int, int], best: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one list of differences (sizes ``d``, position ``p`` of the shingle in each) of sets of sizes ``n`` that may be near enough.

    Entries are sorted by position. Sets differ where their differences do, in at most ``c (nx + ny)`` shingles; the
    position bounds what the differences can share, and the parity bitmaps ``bits`` bound from below in how much they
    differ. Entries of one block meet in a list of their own unless all are of one block. best: one pair for each entry at most.
    """
    a, b = share
    c = (b - a) / (a + b)
    split = block.min() != block.max()
    root, times = np.unique(roots, return_counts=True)
    common = root[times.argmax()]
    rare = np.flatnonzero(roots != common)  # pairs of the most common component with itself need no answer
    for k in range(0, len(rare), 256):
        u = rare[k : k + 256]
        v = np.arange(np.searchsorted(p, (c * n[u] * (1 + b / a) - p[u]).max() + 1e-6, side="right"))
        x, y = u[:, None], v[None, :]
        shared = d[x] + d[y] - c * (n[x] + n[y])  # twice the least overlap of the differences
        ok = (roots[x] != roots[y]) & (shared <= 2 * np.minimum(d[x] - p[x], d[y] - p[y]) + 1e-6)
        ok &= (b * np.minimum(n[x], n[y]) >= a * np.maximum(n[x], n[y])) & ((roots[y] == common) | (x < y))
        if split:
            ok &= block[x] != block[y]
        i, j = np.nonzero(ok)
        slack = c * (n[u[i]] + n[v[j]]) - np.bitwise_count(bits[u[i]] ^ bits[v[j]]).sum(1, dtype=np.int64)
        keep = np.flatnonzero(slack >= -1e-6)
        if best and len(keep):
            keep = keep[np.lexsort((-slack[keep], i[keep]))]
            keep = keep[np.flatnonzero(np.diff(i[keep], prepend=-1))]
        if len(keep):
            yield u[i[keep]], v[j[keep]]


def _parity(w: int) -> Column:
    """Word ``w`` of the parity bitmap of column ``diff``."""
    mine = f"filter(diff, e -> (shiftrightunsigned(e, 6) & {DIFF_WORDS - 1}) = {w})"
    return F.expr(f"aggregate({mine}, 0L, (s, e) -> s ^ shiftleft(1L, CAST(e & 63 AS INT)))").alias(f"w{w}")


def links_by_leader(led: DataFrame, roots: DataFrame, share: tuple[int, int], buckets: int, best: bool, longest: int = 20_000) -> DataFrame:
    """``x, y``: linked sets of different components among those of one leader, from ``led (sid, lead, n, nl, diff, w0, ...)`` and ``roots (node, root)``.

    A list of more than ``longest`` entries is split into blocks, every two of which meet in a task of their own. best: only
    the best partner of each entry of a list is tested.
    """
    a, b = share
    c = (b - a) / (a + b)
    rows = led.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid")).withColumn("d", F.size("diff"))
    # the least overlap of differences with any set of another component; partners of a set that is linked with the leader are not
    inside = F.floor((F.col("d") + c * (F.col("nl") - F.col("n"))) / 2 - 1e-6) + 1
    outside = F.ceil(F.col("d") - c * (1 + b / a) * F.col("n") - 1e-6)
    least = F.greatest(F.lit(1), F.when(F.col("d") * (a + b) <= (b - a) * (F.col("n") + F.col("nl")), inside).otherwise(outside)).cast("int")
    words = [f"w{w}" for w in range(DIFF_WORDS)]
    entries = rows.withColumn("least", least).filter("d >= least").select(
        "lead", "sid", "root", "n", "d", *words, F.posexplode(F.expr("slice(diff, 1, d - least + 1)")).alias("p", "e")
    )
    often = entries.groupBy("lead", "e").agg(F.count("*").alias("m")).filter(F.col("m") > longest)
    often = F.broadcast(often.select("lead", "e", F.ceil(F.col("m") / longest).cast("int").alias("blocks")))  # at most one row for `longest` entries
    placed = entries.join(often, ["lead", "e"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.withColumn("list", F.xxhash64("lead", "e", F.least("own", "other"), F.greatest("own", "other"))).withColumn("bucket", F.pmod("list", F.lit(buckets)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["list", "p"], kind="stable")
        lists, sid, root, n, d, p, own = (pdf[k].to_numpy() for k in ("list", "sid", "root", "n", "d", "p", "own"))
        bits = pdf[words].to_numpy().view(np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
        out = [np.empty((0, 2), np.int64)]
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if j - i > 1 and root[i:j].min() != root[i:j].max():
                for u, v in difference_pairs(root[i:j], n[i:j], d[i:j], p[i:j], bits[i:j], own[i:j], share, best):
                    out.append(np.stack([np.maximum(sid[i + u], sid[i + v]), np.minimum(sid[i + u], sid[i + v])], 1))
                if len(out) > 1000:
                    out = [np.unique(np.concatenate(out), axis=0)]
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["x", "y"])

    pairs = placed.select("bucket", "list", "sid", "root", "n", "d", "p", "own", *words).groupBy("bucket").applyInPandas(run, "x long, y long").distinct()
    side = lambda k: led.select(F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("diff").alias(f"d{k}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    apart = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    return both.filter(apart * (a + b) <= (b - a) * (F.col("nx") + F.col("ny"))).select("x", "y")


def neighbours(keyed: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``x, y``: sets next to each other among those with two minima in common, in order of a third one.

    Rows are dealt by range of all of these, so a large group spreads over tasks; a pair across a task's border is left to the index lists.
    """
    a, b = share
    order = ["k", "low", "low2", "low3", "sid"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, low, low2, sid, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "low", "low2", "sid", "n"))
            ok = (k[1:] == k[:-1]) & (low[1:] == low[:-1]) & (low2[1:] == low2[:-1]) & (b * np.minimum(n[1:], n[:-1]) >= a * np.maximum(n[1:], n[:-1]))
            at = np.flatnonzero(ok)
            x, y = sid[at], sid[at + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["x", "y"])

    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "x long, y long")


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    width = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(width), 0, []
    for k, w in zip(kinds, width, strict=True):
        out.append(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T.copy().view(k).ravel())
        at += n * w
    return out


KINDS = ["<u4", "<u1", "<i8", "<i8", "<i8", "<u4", "<u4"]  # two parts of a hash, id (as a difference), root and leader (as differences from it), set size, position


WORDS = 8  # 64-bit words of a bitmap


def index_entries(sets: DataFrame, levels: np.ndarray, size: int, share: tuple[int, int], buckets: int, hot: int = 255) -> DataFrame:
    """Packed index entries ``bucket, data, maps`` of the prefix of each set of ``sets (sid, root, lead, crowded, text)``, without shingles of a sketch level of ``hot`` or more.

    ``maps`` has, once for each crowded set of a packet, its parity bitmap: bit i says whether an odd number of its
    shingles falls on i.
    """
    shared = sets.sparkSession.sparkContext.broadcast(levels)  # 2 ** sketch_bits bytes
    a, b = share

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        low = np.uint64(len(level) - 1)
        held: list[tuple[np.ndarray, int, int, int, int]] = []
        maps: dict[int, np.ndarray] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda e: e[1])
            h = np.concatenate([e[0] for e in held])
            sizes = [len(e[0]) for e in held]
            sid, root, lead, n = (np.repeat(np.array([e[k] for e in held], np.int64), sizes) for k in (1, 2, 3, 4))
            pos = np.concatenate([np.arange(x) for x in sizes])
            cold = level[(h & low).astype(np.int64)] < hot
            if not cold.all():
                h, sid, root, lead, n, pos = (x[cold] for x in (h, sid, root, lead, n, pos))
            if not len(h):
                return
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            for part in np.split(order, cut):
                i = sid[part]
                data = _pack(
                    (h[part] & np.uint64(0xFFFFFFFF)).astype("<u4"), ((h[part] >> np.uint64(32)) & np.uint64(0xFF)).astype("<u1"),
                    np.diff(i, prepend=0).astype("<i8"), (root[part] - i).astype("<i8"), (lead[part] - i).astype("<i8"), n[part].astype("<u4"), pos[part].astype("<u4"),
                )
                drawn = np.array([x for x in np.unique(i).tolist() if x in maps], np.int64)
                bits = np.array([maps[x] for x in drawn.tolist()], "<u8").reshape(-1, WORDS)
                both = _pack(np.diff(drawn, prepend=0).astype("<i8"), *(np.ascontiguousarray(bits[:, w]) for w in range(WORDS)))
                yield pa.RecordBatch.from_pydict({"bucket": [int(bucket[part[0]])], "data": [data], "maps": [both]})

        for batch in batches:
            sids, roots, leads, crowded = (batch.column(c).to_pylist() for c in ("sid", "root", "lead", "crowded"))
            for k, s in enumerate(shingles([t.encode() for t in batch.column("text").to_pylist()], size)):
                n = len(s)
                if n:
                    keep = n - -(-a * n // b) + 1
                    held.append((s[np.argsort(_rank(s, level), kind="stable")[:keep]], sids[k], roots[k], leads[k], n))
                    if crowded[k]:
                        odd = (np.bincount((s >> np.uint64(8)).astype(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS) & 1).astype(bool)
                        maps[sids[k]] = np.packbits(odd, bitorder="little").view("<u8")
                    count += keep
                    if count >= 1_000_000:
                        yield from flush()
                        held.clear()
                        maps.clear()
                        count = 0
        if held:
            yield from flush()

    return sets.select("sid", "root", "lead", "crowded", "text").mapInArrow(run, "bucket long, data binary, maps binary")


def hot_pairs(sets: DataFrame, levels: np.ndarray, size: int, share: tuple[int, int], hot: int, longest: int) -> DataFrame:
    """Candidate pairs ``x, y, nx, ny`` (x < y) that share an index list of a shingle of sketch level ``hot`` or more.

    Sets with the leader that most sets of a list have need no answer among themselves; they and the others are dealt to blocks of
    about ``longest`` entries, and two blocks meet in a task. So an entry of the common leader is repeated once for each block of the others, of which there are few.
    """
    shared = sets.sparkSession.sparkContext.broadcast(levels)  # 2 ** sketch_bits bytes
    a, b = share

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        low = np.uint64(len(level) - 1)
        for batch in batches:
            sids, roots, leads = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "root", "lead"))
            found = []
            for s in shingles([t.encode() for t in batch.column("text").to_pylist()], size):
                s = s[np.argsort(_rank(s, level), kind="stable")[: len(s) - -(-a * len(s) // b) + 1]] if len(s) else s
                at = np.flatnonzero(level[(s & low).astype(np.int64)] >= hot)
                found.append((s[at].view(np.int64), at))
            of = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
            n = _sizes(batch.column("n"))
            cols = [np.concatenate([h for h, _ in found]) if found else np.empty(0, np.int64), sids[of], roots[of], leads[of], n[of], np.concatenate([p for _, p in found]) if found else np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["h", "sid", "root", "lead", "n", "p"])

    rows = materialize(sets.select("sid", "root", "lead", "n", "text").mapInArrow(entries, "h long, sid long, root long, lead long, n long, p long"), "jac-hot")
    by = rows.groupBy("h", "lead").agg(F.count("*").alias("m"))
    lists = by.groupBy("h").agg(F.sum("m").alias("m"), F.max(F.struct("m", "lead")).alias("top")).filter("m > top.m")
    blocks = lambda c: F.ceil(c / longest).cast("int")
    lists = F.broadcast(lists.select("h", F.col("top.lead").alias("common"), blocks(F.col("top.m")).alias("c"), blocks(F.col("m") - F.col("top.m")).alias("r")))  # a row for `longest` shingles at most
    met = rows.join(lists, "h")
    mine = lambda parts: F.pmod(F.xxhash64("sid"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.expr(f"sequence(0, {parts} - 1)"))
    shape = ["list", "side", "sid", "root", "lead", "n", "p"]
    across = lambda i, j: F.xxhash64("h", F.lit(0), i, j).alias("list")
    first = met.filter("lead = common").withColumn("i", every("r")).withColumn("j", mine("c")).withColumn("side", F.lit(0))
    other = met.filter("lead <> common").withColumn("j", every("c")).withColumn("i", mine("r")).withColumn("side", F.lit(1))
    among = met.filter("lead <> common").withColumn("j", every("r")).withColumn("i", mine("r")).withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1))
    placed = first.withColumn("list", across(F.col("i"), F.col("j"))).select(*shape).unionByName(other.withColumn("list", across(F.col("i"), F.col("j"))).select(*shape))
    placed = placed.unionByName(among.withColumn("list", F.xxhash64("h", F.lit(1), F.least("i", "j"), F.greatest("i", "j"))).select(*shape))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "p"], kind="stable")
        sid, root, lead, n, p, side = (pdf[k].to_numpy() for k in ("sid", "root", "lead", "n", "p", "side"))
        out = [np.empty((0, 4), np.int64)]
        for u, v in list_pairs(root, n, p, share, leads=lead, side=side):
            x, y = sid[u], sid[v]
            turn = x > y
            out.append(np.stack([np.where(turn, y, x), np.where(turn, x, y), np.where(turn, n[v], n[u]), np.where(turn, n[u], n[v])], 1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["x", "y", "nx", "ny"])

    return placed.groupBy("list").applyInPandas(run, "x long, y long, nx long, ny long")


def _sizes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def list_pairs(
    roots: np.ndarray,
    n: np.ndarray,
    p: np.ndarray,
    share: tuple[int, int],
    row: np.ndarray | None = None,
    bits: np.ndarray | None = None,
    leads: np.ndarray | None = None,
    side: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate index pairs of one list, whose entries are sorted by set size, then position. Pairs of one component, or of one leader, are none.

    Entries of one size are a block. Two blocks are skipped when the smaller size can't reach the larger one's share; of
    a block that stays, only entries up to the last position that leaves enough shingles are read. Where both sets have a bitmap (``row`` in ``bits``,
    else -1), the bits in which these differ are shingles in which the sets do, and too many of them skip the pair. Entries of ``side`` 0 meet those of side 1
    only, entries of side 2 meet all.
    """
    a, b = share
    edge = np.flatnonzero(np.diff(n)) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(n)]])
    sizes = n[begin]
    for i, m in enumerate(sizes.tolist()):
        for j in range(i, int(np.searchsorted(sizes, m * b // a, side="right"))):
            k = int(sizes[j])
            need = -(-a * (m + k) // (a + b))  # the least overlap that can suffice
            x_end = begin[i] + np.searchsorted(p[begin[i] : end[i]], m - need, side="right")
            y_end = begin[j] + np.searchsorted(p[begin[j] : end[j]], k - need, side="right")
            xs, ys = np.arange(begin[i], x_end), np.arange(begin[j], y_end)
            for c in range(0, len(xs), 256):
                u, v = xs[c : c + 256, None], ys[None, :]
                ok = roots[u] != roots[v]
                if leads is not None:
                    ok &= leads[u] != leads[v]
                if side is not None:
                    ok &= (side[u] != side[v]) | (side[u] == 2)
                if i == j:
                    ok &= u < v
                u, v = np.nonzero(ok)
                u, v = xs[c + u], ys[v]
                if len(u) and row is not None:
                    ru, rv = row[u], row[v]
                    seen = np.flatnonzero((ru >= 0) & (rv >= 0))
                    differ = np.bitwise_count(bits[ru[seen]] ^ bits[rv[seen]]).sum(1, dtype=np.int64)
                    keep = np.ones(len(u), bool)
                    keep[seen] = differ <= m + k - 2 * need
                    u, v = u[keep], v[keep]
                if len(u):
                    yield u, v


def candidates(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Distinct candidate pairs ``x, y, nx, ny`` (x < y) of sets in different components that share an index list."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = []
        for data in pdf["data"]:
            h, top, i, root, lead, n, p = _unpack(data, KINDS)
            i = np.cumsum(i)
            cols.append((h.astype(np.uint64) | top.astype(np.uint64) << np.uint64(32), i, root + i, lead + i, n.astype(np.int64), p.astype(np.int64)))
        h, ids, roots, leads, n, p = (np.concatenate(c) for c in zip(*cols, strict=True))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(first, len(h)))
        r, leader = roots[order], leads[order]
        mixed = np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)  # a list of one component, or one leader, is skipped as a whole
        mixed &= np.minimum.reduceat(leader, first) != np.maximum.reduceat(leader, first)
        keep = order[np.repeat(mixed, length)]
        keep = keep[np.lexsort((p[keep], n[keep], np.repeat(np.arange(len(first))[mixed], length[mixed])))]
        drawn, bits = [np.empty(0, np.int64)], [np.empty((0, WORDS), np.uint64)]
        for data in pdf["maps"]:
            i, *words = _unpack(data, ["<i8"] + ["<u8"] * WORDS)
            drawn.append(np.cumsum(i))
            bits.append(np.stack(words, 1))
        drawn, first_of = np.unique(np.concatenate(drawn), return_index=True)
        bits = np.concatenate(bits)[first_of]
        row = np.full(len(ids), -1)
        if len(drawn):
            near = np.minimum(np.searchsorted(drawn, ids), len(drawn) - 1)
            row = np.where(drawn[near] == ids, near, -1)
        out, at = [], 0
        for m in length[mixed].tolist():
            k = keep[at : at + m]
            at += m
            for u, v in list_pairs(roots[k], n[k], p[k], share, row[k], bits, leads[k]):
                out.append(np.stack([ids[k[u]], ids[k[v]], n[k[u]], n[k[v]]], 1))
            if len(out) > 1000:
                out = [np.unique(np.concatenate(out), axis=0)]
        got = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 4), np.int64)
        got = got[got[:, 0] != got[:, 1]]
        swap = got[:, 0] > got[:, 1]
        got[swap] = got[swap][:, [1, 0, 3, 2]]
        return pd.DataFrame(got, columns=["x", "y", "nx", "ny"])

    return entries.groupBy("bucket").applyInPandas(run, "x long, y long, nx long, ny long").distinct()


def _with_group(keyed: DataFrame, of_group: DataFrame, crowd: DataFrame, large: int = 2_000, most: int = 100_000) -> DataFrame:
    """``keyed`` joined with the row of each group ``(k, low)``; rows of large groups are not shuffled but meet a broadcast of at most ``most`` groups."""
    size = crowd.agg(F.sum("m")).first()[0] or 0
    hot = F.broadcast(crowd.filter(F.col("m") > max(large, size // most)).select("k", "low"))
    few = keyed.join(hot, ["k", "low"], "left_anti").join(of_group, ["k", "low"])
    return few.unionByName(keyed.join(F.broadcast(of_group.join(hot, ["k", "low"], "left_semi")), ["k", "low"]).select(*few.columns))


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id``; the rest of the contract, and what ``how`` may hold, is that of ``text_classes``."""
    return text_classes(docs, id_col, text_col, **how).select("doc_id", "n_shingles", "component_id")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without those that are similar to another one: of each class the row with the least id, then the least hash of its text.

    Rows are judged by id and text together, so that unlike texts of one id all stay. Of rows with equal id and text one stays (which of them, where other
    columns differ, is not defined). Rows without words, or null, all stay. A null id is the least. Columns are those of ``docs``.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID))
    found = text_classes(docs, id_col, text_col, **how).withColumn("__id", F.coalesce("doc_id", F.lit(LEAST_ID))).withColumnRenamed("text_hash", "__th")
    first = found.filter("n_shingles > 0").groupBy("class_id").agg(F.min(F.struct("__id", "__th")).alias("m")).select("m.*", F.lit(True).alias("__one"))
    rest = found.filter("n_shingles = 0").select("__id", "__th").distinct().withColumn("__one", F.lit(False))
    stay = materialize(first.unionByName(rest), "jac-stay")
    keyed = docs.withColumn("__id", key).withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = keyed.join(stay, ["__id", "__th"])
    repeated = found.filter("n_shingles > 0").groupBy("__id", "__th").count().filter("count > 1")
    if not repeated.isEmpty():
        repeated = materialize(repeated.join(stay, ["__id", "__th"], "left_semi").select("__id", "__th"), "jac-repeated")
        kept = kept.join(repeated, ["__id", "__th"], "left_anti").unionByName(kept.join(repeated, ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


LEAST_ID = -(1 << 63)


def text_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similarity: tuple[int, int] = (80, 100),
    hashes: int = 6,
    entries_a_bucket: int = 1_000_000,
    longest: int = 1 << 15,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, text_hash, class_id``.

    Rows link when the Jaccard similarity of their sets of distinct ``size``-word shingles is ``similarity`` (a ratio of whole
    numbers, below 1) or more; ``component_id`` is the least id that links reach. A text of fewer words has
    its whole sequence as one shingle; one without words, or null, has none and links with nothing. Each row is a
    document of its own, also where ids repeat: ``class_id`` tells classes apart (null without words), ``text_hash`` rows of one id. A null id counts as the
    least. Other columns are ignored; an empty table gives no rows.

    hashes: minima a set is compared by in step 2. entries_a_bucket: index entries that one task reads at once. longest: lists of shingles
    that may be in more texts are split into blocks that meet in tasks of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    rows = docs.count()
    bits = min(24, max(14, math.ceil(math.log2(max(1, rows * 8)))))
    seen = materialize(profile(base, size, hashes, bits), "jac-profile")
    per_doc = seen.filter("seg IS NULL")
    levels = sketch_levels(seen, bits)
    sets = (
        per_doc.filter("n > 0")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("id"), F.min_by("th", "doc_id").alias("th"), F.max("n").alias("n"))
        .withColumn("sid", F.monotonically_increasing_id())
    )
    sets = materialize(sets, "jac-sets")
    # the text of each set, written by bucket of its id, so that later joins don't shuffle it
    total = sets.agg(F.sum("n"), F.count("*")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total[0] or 0) / 4_000_000))
    one = base.join(sets.select(F.col("id").alias("doc_id"), "th", "sid", "n"), ["doc_id", "th"])
    if not per_doc.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():  # rows that repeat as a whole
        one = one.dropDuplicates(["sid"])
    name, path = f"tessera_{new_dir(spark, 'texts').rsplit('-', 1)[1]}", new_dir(spark, "jac-texts")
    (
        one.select("sid", "n", "text").repartition(buckets, "sid").write.option("compression", "zstd").option("path", path)
        .bucketBy(buckets, "sid").sortBy("sid").saveAsTable(name)
    )
    try:
        final = _linked_sets(sets, per_doc, spark.table(name), levels, total[0] or 0, size, similarity, hashes, entries_a_bucket, longest)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    back = lambda c: F.when(c == LEAST_ID, None).otherwise(c)
    shown = back(F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    rows = per_doc.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set_id", F.col("th").alias("text_hash")).join(final, "set_id", "left")
    return rows.select(back(F.col("doc_id")).alias("doc_id"), "n_shingles", shown.alias("component_id"), "text_hash", F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id"))


def _linked_sets(
    sets: DataFrame, per_doc: DataFrame, texts: DataFrame, levels: np.ndarray, shingle_count: int, size: int, similarity: tuple[int, int], hashes: int, entries_a_bucket: int, longest: int
) -> DataFrame:
    """``set_id, component_id, class_id`` of all ``sets``; ``texts`` is bucketed by set."""
    a, b = similarity
    mins = per_doc.filter("n > 0").select("doc_id", "th", "mins").dropDuplicates(["doc_id", "th"])

    # step 2: leaders
    following = F.transform("mins", lambda m, k: F.struct(k.alias("k"), m.alias("low"), F.get("mins", (k + 1) % hashes).alias("low2"), F.get("mins", (k + 2) % hashes).alias("low3")))
    keyed = sets.select(F.col("id").alias("doc_id"), "th", "sid", "n").join(mins, ["doc_id", "th"]).select("sid", "n", F.explode(following).alias("m"))
    keyed = materialize(keyed.select("sid", "n", "m.*"), "jac-mins")
    # the leader has the most common minima of all: it is the set from which the others of its group differ least
    crowd = materialize(keyed.groupBy("k", "low").agg(F.count("*").alias("m")).filter("m > 1"), "jac-crowds")
    fame = _with_group(keyed, crowd.select("k", "low", "m"), crowd).groupBy("sid").agg(F.sum("m").alias("fame"))
    famed = materialize(keyed.join(fame, "sid").select("sid", "n", "k", "low", "fame"), "jac-famed")
    groups = famed.groupBy("k", "low").agg(F.max(F.struct("fame", "sid", "n")).alias("top"), F.count("*").alias("m")).filter("m > 1")
    groups = materialize(groups.select("k", "low", F.col("top.sid").alias("y"), F.col("top.n").alias("ny"), F.col("top.fame").alias("fame")), "jac-leaders")
    stars = _with_group(keyed, groups, crowd).filter(f"sid <> y AND {b} * least(n, ny) >= {a} * greatest(n, ny)").select(F.col("sid").alias("x"), "y", "fame")
    stars = stars.unionByName(neighbours(keyed, similarity).withColumn("fame", F.lit(0).cast("long"))).groupBy("x", "y").agg(F.max("fame").alias("fame"))
    led = materialize(overlaps(stars, texts, size, levels), "jac-led")
    linked = f"{b} * inter >= {a} * (nx + ny - inter)"
    first_roots = materialize(components(led.filter(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))), "jac-roots")

    # step 3: sets with one leader; of several leaders the most famous one, so that sets that are near each other have the same
    mine = led.filter("diff IS NOT NULL AND fame > 0").groupBy("x").agg(F.max_by(F.struct("y", "nx", "ny", "diff"), F.struct("fame", "y")).alias("m"))
    mine = mine.select(F.col("x").alias("sid"), F.col("m.y").alias("lead"), F.col("m.nx").alias("n"), F.col("m.ny").alias("nl"), F.col("m.diff").alias("diff"))
    mine = materialize(mine.select("*", *[_parity(w) for w in range(DIFF_WORDS)]), "jac-mine")  # once for each set
    index_buckets = min(1 << 16, max(16, math.ceil(shingle_count * (b - a) / b / entries_a_bucket)))
    lead_buckets = max(16, math.ceil(index_buckets / 4))
    best = materialize(links_by_leader(mine, first_roots, similarity, lead_buckets, best=True), "jac-best")
    first_roots = materialize(components(first_roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(best.toDF("a", "b"))), "jac-roots")
    derived = materialize(links_by_leader(mine, first_roots, similarity, lead_buckets, best=False), "jac-derived")

    # step 4: index lists
    crowded = famed.select("sid", F.lit(True).alias("crowded")).distinct()
    marks = first_roots.withColumnRenamed("node", "sid").join(crowded, "sid", "full").join(mine.select("sid", "lead"), "sid", "full")
    tagged = texts.join(marks, "sid", "left").select(
        "sid", F.coalesce("root", "sid").alias("root"), F.coalesce("lead", "sid").alias("lead"), F.coalesce("crowded", F.lit(False)).alias("crowded"), "n", "text"
    )
    # shingles that so many texts hold that one task should not read their list; a sketch slot counts at least what is in it
    hot = math.ceil(math.log2(longest))
    found = candidates(index_entries(tagged, levels, size, similarity, index_buckets, hot), similarity)
    if int(levels.max(initial=0)) >= hot:
        found = found.unionByName(hot_pairs(tagged, levels, size, similarity, hot, longest)).distinct()
    pairs = materialize(found, "jac-pairs")
    met = overlaps(pairs.select("x", "y"), texts, size).filter(linked).select("x", "y")
    more = materialize(met.unionByName(derived), "jac-links")
    root = first_roots.select(F.col("node"), F.col("root"))
    edges = (
        more.join(root.select(F.col("node").alias("x"), F.col("root").alias("rx")), "x", "left")
        .join(root.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y", "left")
        .select(F.coalesce("rx", "x").alias("a"), F.coalesce("ry", "y").alias("b"))
    )
    second = components(edges).select(F.col("node").alias("r1"), F.col("root").alias("r2"))
    placed = (
        sets.join(root.withColumnRenamed("node", "sid"), "sid", "left")
        .select("set_id", "id", F.coalesce("root", "sid").alias("r1"))
        .join(second, "r1", "left")
        .select("set_id", "id", F.coalesce("r2", "r1").alias("r"))
    )
    least = placed.groupBy("r").agg(F.min("id").alias("component_id"))
    return materialize(placed.join(least, "r").select("set_id", "component_id", F.col("r").alias("class_id")), "jac-classes")
