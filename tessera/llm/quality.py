"""Quality of texts by ordinal regression on graded ratings.

A cumulative-link model: all grades share one weight for each hashed feature of the text, and ordered
thresholds cut the score into grades. It gives the probability of every grade or more (a tail
probability, to select by) and their sum, the expected grade.

Features are hashed token shapes (``Word,`` is ``Aa,``), hashed lower-case words, both as shares of the text's tokens,
and bands of five measures: distinct tokens, immediate repeats, capitals, signs, and length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import fit_ordinal, sigmoid
from tessera.llm.sampling import labelled_texts
from tessera.llm.textnum import LOWER, SPACE, chunks, spans, word_hashes
from tessera.plans.scratch import materialize

BITS = 14
BANDS = 12
MEASURES = 5
N_FEATURES = (1 << BITS) + BANDS * MEASURES
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 57
SPREAD = 3.0  # shares are small numbers; this brings them to the size of the bands


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows ``(indptr, indices, values)``, one for each text."""
    indptr, indices, values = [0], [], []
    with np.errstate(over="ignore"):
        for first, last, raw, starts in chunks(texts):
            begin, end = spans(~SPACE[raw])
            words = word_hashes(LOWER[raw], begin, end)
            shape = np.where(SPACE[raw], np.uint8(32), SHAPE[raw])
            kept = np.flatnonzero(np.concatenate([[True], shape[1:] != shape[:-1]]))
            s_begin, s_end = spans(shape[kept] != 32)
            shapes = word_hashes(shape[kept], s_begin, s_end)
            at = np.searchsorted(begin, starts)
            upper = np.concatenate([[0], np.cumsum(shape == 65)])
            signs = np.concatenate([[0], np.cumsum((shape != 65) & (shape != 97) & (shape != 32))])
            for k in range(last - first):
                a, b = at[k], at[k + 1]
                n, size = b - a, max(1, len(texts[first + k]))
                w = words[a:b]
                bins = np.concatenate([w >> np.uint64(64 - BITS), shapes[a:b] >> np.uint64(64 - BITS)]).astype(np.int64)
                found, count = np.unique(bins, return_counts=True)
                x, y = starts[k], starts[k + 1] - 1
                shares = (
                    len(np.unique(w)) / max(1, n),
                    (w[1:] == w[:-1]).sum() / max(1, n),
                    (upper[y] - upper[x]) / size,
                    (signs[y] - signs[x]) / size,
                    min(1.0, np.log2(1 + n) / 16),
                )
                bands = [(1 << BITS) + BANDS * m + min(BANDS - 1, int(s * BANDS)) for m, s in enumerate(shares)]
                indices.append(np.concatenate([found, bands]))
                values.append(np.concatenate([SPREAD * count / max(1, n), np.ones(MEASURES)]))
                indptr.append(indptr[-1] + len(found) + MEASURES)
    empty = [np.empty(0)]
    return np.array(indptr), np.concatenate(indices or empty).astype(np.int64), np.concatenate(values or empty)


def learn(sample: DataFrame, max_grades: int) -> dict:
    """Weights, thresholds and grades from ``sample (text, label)``, the bounded sample; equal texts count once, with their lowest label."""
    rows = materialize(sample.groupBy("text").agg(F.min("label").cast("double").alias("label")), "quality-sample")
    grades = [r["label"] for r in rows.select("label").distinct().orderBy("label").limit(max_grades + 1).collect()]
    if len(grades) > max_grades:
        raise ValueError(f"more than {max_grades} grades")
    if len(grades) < 2:
        return {"grades": grades, "weights": np.zeros(N_FEATURES), "thresholds": np.empty(0)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, i, v = features([t.encode() for t in batch.column("text").to_pylist()])
            lists = [pa.ListArray.from_arrays(pa.array(p, pa.int32()), pa.array(x, t)) for x, t in ((i, pa.int32()), (v, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *lists], ["label", "i", "v"])

    got = rows.mapInArrow(sparse, "label double, i array<int>, v array<float>").toPandas()
    indptr = np.concatenate([[0], np.cumsum(got["i"].map(len).to_numpy())])
    indices, values = np.concatenate(got["i"].tolist()).astype(np.int64), np.concatenate(got["v"].tolist()).astype(float)
    level = np.searchsorted(np.array(grades), got["label"].to_numpy())
    w, t = fit_ordinal(indptr, indices, values, level, N_FEATURES, len(grades), l2=1e-4, steps=250)
    return {"grades": grades, "weights": w, "thresholds": t}


def rate_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = 10_000,
    min_tail: float = 0.5,
    tail_grade: int = 1,
    max_grades: int = 16,
    seed: int = 9,
) -> DataFrame:
    """The columns of ``docs`` and ``expected_grade, tail, selected``.

    ``labels`` (id, rating) name the rows of ``docs`` to learn from, of which about ``fit_rows`` are used. Ratings
    are grades in their order; ``expected_grade`` counts in steps from the lowest (0). ``tail`` is the probability
    of grade ``tail_grade`` or more, and ``selected`` says that it is ``min_tail`` at least. A null text counts as empty.
    With ratings of one grade, or none, the expected grade is 0, the tail 1 and all are selected. Repeated rows
    and ids change nothing; columns called like the new ones are replaced; an empty table gives no rows.
    """
    sample = labelled_texts(docs, labels, id_col, text_col, label_col, fit_rows, seed)
    shared = docs.sparkSession.sparkContext.broadcast(learn(sample, max_grades))

    @F.pandas_udf("struct<expected_grade:double,tail:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        if not len(model["thresholds"]):
            return pd.DataFrame({"expected_grade": np.zeros(len(texts)), "tail": np.ones(len(texts))})
        p, i, v = features([t.encode() for t in texts])
        score = np.bincount(np.repeat(np.arange(len(texts)), np.diff(p)), v * model["weights"][i], minlength=len(texts))
        tails = sigmoid(score[:, None] - model["thresholds"][None, :])
        return pd.DataFrame({"expected_grade": tails.sum(1), "tail": tails[:, min(tail_grade, tails.shape[1]) - 1]})

    found = docs.withColumn("__said", predict(F.coalesce(F.col(text_col), F.lit(""))))
    return found.withColumns(
        {"expected_grade": F.col("__said.expected_grade"), "tail": F.col("__said.tail"), "selected": F.col("__said.tail") >= min_tail}
    ).drop("__said")
