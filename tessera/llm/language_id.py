"""Language identification with bit-sliced Bloom filters of n-grams.

All languages share one filter whose slots are bitmasks with a bit for each language. An n-gram sets its
language's bit in a few slots; the conjunction of those slots gives all languages that may hold it at
once. A document counts, for each language, the n-grams whose mask has its bit. The share of slots in
which a bit is set tells how often an n-gram that is not in the language looks as if it were, and counts are corrected
for that before they decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textnum import LETTER, chunks
from tessera.plans.batches import small_batches

GRAMS = (2, 3, 4, 5)
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _codes(buf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n bytes at each place as one number, and whether they lie in one word with at most a blank at either end."""
    m = len(buf) - n + 1
    code = np.zeros(m, np.uint64)
    for k in range(n):
        code |= buf[k : k + m].astype(np.uint64) << np.uint64(8 * k)
    letter = buf != 32
    ok = letter[1 : 1 + m].copy() if n == 2 else np.ones(m, bool)
    for k in range(1, n - 1):
        ok &= letter[k : k + m]
    return code, ok


def _slots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [((code ^ (code >> np.uint64(17))) * np.uint64(f)) >> np.uint64(64 - bits) for f in FACTORS[:2]]


def _letters(raw: np.ndarray) -> np.ndarray:
    return np.where(LETTER[raw], raw, np.uint8(32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language in a batch."""
    for batch in batches:
        cols = batch.to_pydict()
        for lang in sorted(set(cols["lang"])):
            texts = [t.encode() for t, at in zip(cols["text"], cols["lang"], strict=True) if at == lang]
            for _, _, raw, _ in chunks(texts):
                buf = _letters(raw)
                for n in GRAMS:
                    if len(buf) >= n:
                        code, ok = _codes(buf, n)
                        found, times = np.unique(code[ok], return_counts=True)
                        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "size": np.full(len(found), n, np.int32), "gram": found.view(np.int64), "n": times})


def fit(labelled: DataFrame, text_col: str, lang_col: str, bits: int = 20, least_share: float = 1e-5, max_languages: int = 64) -> dict:
    """The filter: ``languages, slots (2**bits masks), fill`` (false-positive rate of each language).

    The mask of an n-gram names every language that contains it, however much more often another one does. A language
    contains what makes up ``least_share`` of its n-grams of that length: less comes from quotes and wrong labels, with
    which in time every text of a language would hold all n-grams of the others. What reaches the driver is bounded by ``2**bits``
    slots of one mask each.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = [r["lang"] for r in found]
    slots = np.zeros(1 << bits, np.uint64)
    if languages:
        counts = rows.select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text")).mapInArrow(_count, "lang string, size int, gram long, n long")
        counts = counts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
        totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
        bit = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(len(languages))])
        place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int")
        inside = counts.join(F.broadcast(totals), ["lang", "size"]).filter(F.col("n") >= least_share * F.col("total"))
        kept = inside.groupBy("size", "gram").agg(F.bit_or(F.element_at(bit, place)).alias("mask"))

        def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gram = b.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
                mask = b.column("mask").to_numpy(zero_copy_only=False)
                for s in _slots(gram, bits):
                    yield pa.RecordBatch.from_pydict({"slot": s.astype(np.int64), "mask": mask})

        placed = kept.mapInArrow(to_slots, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
        slots[placed["slot"].to_numpy()] = placed["mask"].to_numpy().view(np.uint64)
    n = len(languages)
    slots = slots.astype(np.uint8 if n <= 8 else np.uint16 if n <= 16 else np.uint32 if n <= 32 else np.uint64)
    fill = [float(((slots >> slots.dtype.type(k)) & slots.dtype.type(1)).mean()) ** 2 for k in range(n)]
    prior = [r["count"] for r in found]
    return {"languages": languages, "slots": slots, "fill": fill, "bits": bits, "first": prior.index(max(prior)) if prior else -1}


def counts_of(texts: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Corrected counts ``(texts, languages)`` and all n-grams of each lower-case text."""
    n = len(model["languages"])
    hits, total = np.zeros((len(texts), n)), np.zeros(len(texts))
    slots, one = model["slots"], model["slots"].dtype.type(1)
    for first, last, raw, starts in chunks(texts):
        buf = _letters(raw)
        for size in GRAMS:
            if len(buf) < size:
                continue
            code, ok = _codes(buf, size)
            a, b = _slots(code, model["bits"])
            masks = np.where(ok, slots[a] & slots[b], slots.dtype.type(0))
            at = np.minimum(starts[:-1] - 1, len(masks) - 1)
            total[first:last] += np.add.reduceat(ok, at, dtype=np.int64)
            for k in range(n):
                hits[first:last, k] += np.add.reduceat((masks >> slots.dtype.type(k)) & one, at, dtype=np.int64)
    fill = np.array(model["fill"])
    return np.maximum(0.0, (hits - total[:, None] * fill) / np.maximum(1e-9, 1 - fill)), total


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fit_rows: int = 20_000,
    seed: int = 4,
    **options,
) -> DataFrame:
    """The columns of ``docs`` and ``lang_pred, score``: the language and its share of all corrected counts.

    About ``fit_rows`` rows of ``labelled`` with a text and a language are used to learn, chosen by hash. Texts without a letter (also
    null and empty ones) are ``und`` with score 0; so is every text if nothing could be learned. Ties go to
    the first language in order of name; a text none of whose n-grams is known gets the language with most
    labelled rows and score 0. Extra columns, repeated rows and ids change nothing. An empty table gives no rows.
    Columns of ``docs`` called like the two new ones are replaced.
    """
    small_batches(docs.sparkSession)
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    marks = [c for c in (id_col, text_col) if c in known.columns]
    share = min(1.0, fit_rows / max(1, known.count()))
    taken = F.pmod(F.xxhash64(*marks, F.lit(seed)), F.lit(1 << 30)) < math.floor(share * (1 << 30))
    model = fit(known.filter(taken), text_col, lang_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits masks at most

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        if not model["languages"]:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts))})
        c, _ = counts_of([t.encode() if t else b"" for t in texts], model)
        best, whole = c.argmax(1), c.sum(1)
        best = np.where(whole > 0, best, model["first"])
        score = np.where(whole > 0, c[np.arange(len(c)), best] / np.where(whole > 0, whole, 1), 0.0)
        return pd.DataFrame({"lang_pred": np.array(model["languages"], dtype=object)[best], "score": score})

    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("__said", predict(F.lower(text))).withColumn("__letters", F.col(text_col).isNotNull() & text.rlike(r"\p{L}"))
    return found.withColumns(
        {
            "lang_pred": F.when(F.col("__letters"), F.col("__said.lang_pred")).otherwise("und"),
            "score": F.when(F.col("__letters"), F.col("__said.score")).otherwise(0.0),
        }
    ).drop("__said", "__letters")


def keep_identified(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages, with all their columns."""
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col(text_col).alias("text"))
    marked = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return identify(whole, marked, **options).filter("lang_pred <> 'und'").select("whole.*")
