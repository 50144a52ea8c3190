"""Importance resampling of documents towards a target collection, by hashed word and word-pair features.

1. Head: the frequent words and pairs of words of all documents, found by bounded counters in every task, are broadcast. A
   frequent word comes with its exact CRC, its length, and the state of the CRC after the word and a blank; a frequent
   pair with its bucket. The head decides how a bucket is found, never which one.
2. Tail: features with a word outside the head take their CRC directly, from the state of the first word if that is known. Pairs of
   frequent words that aren't frequent themselves are put together from state, CRC and length, many at once.
3. One pass counts the features of each bucket exactly, for documents and target; the gain of a bucket compares both. A second
   pass gives each document the mean gain of its features.
4. Documents are drawn without replacement by weight plus a Gumbel number from their id. Scores are whole numbers in a narrow range, so
   the number of documents of each score says which scores are drawn and where their ranks begin.

Texts are never shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import materialize

#: Digits, a to z, and all characters beyond ASCII, in lower-cased (A-Z) UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
OTHER = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 20
#: Longest frequent word, in bytes.
LONGEST = 64


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        end = OTHER.search(text, at + BLOCK)
        end = end.start() if end else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def _byte_step() -> np.ndarray:
    """What a byte of CRC-32 (reflected polynomial 0xEDB88320) turns into when a zero byte follows."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


STEP = _byte_step()


def after_blank(crc: np.ndarray) -> np.ndarray:
    """The CRCs that ``crc`` turn into when a blank follows."""
    state = ~crc
    return ~(STEP[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)))


def zero_shifts(longest: int) -> np.ndarray:
    """``[n, k, b]``: the state whose byte ``k`` is ``b`` and whose others are zero, after ``n`` zero bytes. States add up by exclusive or."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    out = [now]
    for _ in range(longest):
        now = (now >> np.uint32(8)) ^ STEP[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


class Head:
    """Frequent words and pairs, and the buckets of any features."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> None:
        self.buckets, self.words = buckets, words
        self.crc = np.array([*map(zlib.crc32, words), 0], np.uint32)  # the last row stands for all other words
        self.state = after_blank(self.crc)
        self.length = np.array([*map(len, words), 0], np.int64)
        self.code = {w: k for k, w in enumerate(words)}
        known = sorted((self.code[a] << 32 | self.code[b], zlib.crc32(b, int(self.state[self.code[a]])) % buckets) for a, b in pairs if a in self.code and b in self.code)
        self.pair_key, self.pair_bucket = np.array([*(k for k, _ in known), 1 << 62], np.int64), np.array([*(b for _, b in known), 0], np.int64)
        self.shift = zero_shifts(max(map(len, words), default=0))

    def _together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Buckets of pairs of frequent words: the first one's state moves on by the second one's length."""
        state, n = self.state[a], self.length[b]
        crc = self.crc[b]
        for k in range(4):
            crc = crc ^ self.shift[n, k, (state >> np.uint32(8 * k)) & np.uint32(255)]
        return crc.astype(np.int64) % self.buckets

    def of(self, words: list[bytes], before: bytes | None = None) -> np.ndarray:
        """Buckets of all words and of all pairs of consecutive words, also of ``before`` and the first one."""
        every = words if before is None else [before, *words]
        get = self.code.get
        code = np.array([get(w, -1) for w in every], np.int64)
        crc = self.crc[code]
        tail = np.flatnonzero(code < 0)
        crc[tail] = [zlib.crc32(every[i]) for i in tail.tolist()]
        a, b = code[:-1], code[1:]
        two, head = np.empty(len(a), np.int64), (a >= 0) & (b >= 0)
        ha, hb = a[head], b[head]
        key = ha << 32 | hb
        at = np.searchsorted(self.pair_key, key)
        found, seen = self.pair_bucket[at], self.pair_key[at] == key
        found[~seen] = self._together(ha[~seen], hb[~seen])
        two[head] = found
        rest = np.flatnonzero(~head)
        state = after_blank(crc[rest])
        two[rest] = [zlib.crc32(every[i], c) % self.buckets for i, c in zip((rest + 1).tolist(), state.tolist(), strict=True)]
        one = crc.astype(np.int64) % self.buckets
        return np.concatenate([one if before is None else one[1:], two])

    def features(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """Number of words and buckets of the features, block by block."""
        before = None
        for words in word_blocks(text):
            if words:
                yield len(words), self.of(words, before)
                before = words[-1]


def _thin(counts: Counter, most: int) -> None:
    """Forget the rarer half of a counter of more than ``4 * most`` entries."""
    if len(counts) > 4 * most:
        bound = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -2 * most)[-2 * most]
        for k in [k for k, v in counts.items() if v <= bound]:
            del counts[k]


class _PairCounts:
    """Counts of the pairs of the most frequent words of a task, in a square table. The words are chosen anew whenever four times as many were seen."""

    def __init__(self, most: int, side: int = 1024) -> None:
        self.most, self.side, self.seen, self.due = most, side, 0, 256
        self.hot, self.code, self.table, self.total = [], {}, np.zeros(side * side if most else 0, np.int64), Counter()

    def flush(self) -> None:
        at = np.flatnonzero(self.table)
        for i, n in zip(at.tolist(), self.table[at].tolist(), strict=True):
            self.total[self.hot[i // self.side], self.hot[i % self.side]] += n
        self.table[at] = 0
        _thin(self.total, self.most)

    def add(self, block: list[bytes], words: Counter) -> None:
        self.seen += len(block)
        if self.seen >= self.due and self.most:
            self.flush()
            self.hot, self.due = [w for w, _ in words.most_common(self.side)], 4 * self.seen
            self.code = {w: k for k, w in enumerate(self.hot)}
        if self.hot:
            get = self.code.get
            code = np.array([get(w, -1) for w in block], np.int64)
            a, b = code[:-1], code[1:]
            head = (a >= 0) & (b >= 0)
            np.add.at(self.table, a[head] * self.side + b[head], 1)


def frequent(docs: DataFrame, text_col: str, head_words: int, head_pairs: int) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """The words and pairs of words that are most frequent in all of ``docs``, as far as each task's bounded counters can tell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Counter(), _PairCounts(head_pairs)
        for batch in batches:
            for text in batch.column(0):
                for block in word_blocks((text.as_py() or "").encode()):
                    words.update(block)
                    pairs.add(block, words)
                    _thin(words, head_words)
        pairs.flush()
        top = [(w, None, n) for w, n in words.most_common(head_words) if len(w) <= LONGEST]
        top += [(*p, n) for p, n in pairs.total.most_common(head_pairs)]
        a, b, n = zip(*top, strict=True) if top else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    total = docs.select(text_col).mapInArrow(run, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    total = materialize(total, "head")
    top = lambda kind, most: [tuple(map(bytes, filter(None, (r["a"], r["b"])))) for r in total.filter(kind).orderBy(F.desc("n"), "a", "b").limit(most).collect()]
    return [w for (w,) in top("b IS NULL", head_words)], top("b IS NOT NULL", head_pairs)


def bucket_totals(docs: DataFrame, text_col: str, head: Head) -> np.ndarray:
    """The number of features of all rows in each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(head)  # head_words and head_pairs entries at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        total = np.zeros(head.buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in head.features((text.as_py() or "").encode()):
                    total += np.bincount(found, minlength=head.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(head.buckets, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    every, of_target, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (every + k) / ((s + 1) * (of_target + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, id_col: str, text_col: str, head: Head, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the mean gain of all features, rounded down; 0 without features."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = n = total = 0
                for k, found in head.features((text.as_py() or "").encode()):
                    words, n, total = words + k, n + len(found), total + int(gain[found].sum())
                rows.append((words, n, total // n if n else 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", "n_words", "n_features", "weight"])

    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return asked.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = 10_000,
    min_words: int = 20,
    percent: int = 25,
    seed: int = 7,
    head_words: int = 1 << 14,
    head_pairs: int = 1 << 14,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_features, weight, score, rank``.

    Features are all words (lower-cased A-Z; digits, letters a to z and characters beyond ASCII) and pairs of consecutive words, repeats
    counted. ``weight`` is the mean gain of the features, in thousandths, rounded down; ``score`` adds Gumbel noise from ``seed`` and id. Of
    the rows with at least ``min_words`` words, ``percent`` of a hundred are drawn, highest scores first, ties by lesser id, then fewer features,
    then lesser weight (null ids, which count as no digits, first); ``rank`` counts them from 1 and is null for the others. Null texts count as empty: no
    features, weight 0. Each row is a document of its own, also where ids repeat. Other columns are ignored; empty tables give no rows, or no gain.

    head_words, head_pairs: size of the broadcast vocabulary; it changes the time, not the rows.
    """
    head = Head(*frequent(docs, text_col, head_words, head_pairs), buckets)
    gain = gains(bucket_totals(docs, text_col, head), bucket_totals(target, target_text_col, head))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weigh(docs, id_col, text_col, head, gain).withColumn("score", F.col("weight") + noise), "resample")

    able = F.col("n_words") >= min_words
    # one row for each score: whole numbers within a thousand times the logarithms of row counts and of 2**33
    steps = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    steps = materialize(steps.withColumn("above", F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))), "resample-steps")
    number = (steps.agg(F.sum("n")).first()[0] or 0) * percent // 100
    within = steps.filter(F.coalesce("above", F.lit(0)) < number).select("score", F.coalesce("above", F.lit(0)).alias("above"))
    least = within.agg(F.min("score")).first()[0]
    names = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    high = able & (F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")) + F.col("above")
    ranked = scored.filter(high).join(F.broadcast(within), "score").withColumn("rank", place.cast("long"))
    ranked = ranked.select(*names, F.when(F.col("rank") <= number, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.filter(~high).select(*names, F.lit(None).cast("long").alias("rank")))
