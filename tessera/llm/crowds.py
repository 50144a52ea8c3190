"""Joins with one row for each key, where a key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that meet a broadcast are this many at most.
MOST = 100_000


def join_counted(many: DataFrame, one: DataFrame, key: str, count: str, total: int, large: int = 2_000) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has one row for each ``key`` and the number of its rows in ``many`` as ``count``.

    Rows of a key with more than ``large`` rows, or more than ``total / MOST``, are not shuffled: these keys, ``MOST`` at
    most, are broadcast. ``many`` is read twice, so it should be a written table. The column ``count`` is dropped.
    """
    bound = max(large, total // MOST)
    heavy = one.filter(F.col(count) > bound).drop(count)
    light = one.filter(F.col(count) <= bound).drop(count)
    few = many.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return few.unionByName(many.join(F.broadcast(heavy), key).select(*few.columns))
