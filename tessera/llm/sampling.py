"""Bounded samples of labelled rows to learn from."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, seed: int) -> DataFrame:
    """``text, label`` of about ``fit_rows`` rows of ``labels`` (non-null label and id), chosen by a hash of the id.

    Only the chosen ids and labels are broadcast, ``fit_rows`` small rows, so no text is shuffled. Rows without a text are left out.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    share = min(1.0, fit_rows / max(1, known.count()))
    taken = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) < math.floor(share * (1 << 30))
    chosen = known.filter(taken).select(F.col(id_col).alias("__label_id"), F.col(label_col).alias("label"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), F.col("__id") == F.col("__label_id")).select("text", "label")
