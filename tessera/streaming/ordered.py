"""Stateful stream operators: rows in event-time order across batches, and ids that were seen before.

All keep their state in RocksDB state stores, which Spark checkpoints with the query, so a lost executor loses none of it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def use_rocks(spark: SparkSession) -> None:
    """State with timers and maps needs this state store; queries that run already keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class InOrder(StatefulProcessor):
    """Rows of a key wait until the watermark has passed their time; then ``step`` gets them in order of time and tie.

    Keys are dealt to buckets by hash, and a bucket is what Spark groups by: its rows and what is known of its keys are read and written in one
    go, as JSON of many, so a batch costs by its rows and buckets, not a trip to the state store for every key or row. A bucket has one timer, at its
    earliest waiting row or end of a key. ``keep`` microseconds after the last row that was handed over, what is known of a key is forgotten; None keeps it. Rows behind
    the watermark never arrive here: Spark drops and counts them.
    """

    #: The mark after which no row of a key is given out any more, if there is one.
    END: str | None = None

    def __init__(self, keep: int | None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.last = handle.getValueState("last", "rows string")
        self.timer = handle.getValueState("timer", "ms long")

    def step(self, last: str | None, rows: list[tuple]) -> tuple[list[str], str | None]:
        """The payloads of ``rows (who, at, tie, mark, payload)`` of a key to give out, and what to know of it from now on."""
        raise NotImplementedError

    def ended(self, last: str | None) -> bool:
        return self.END is not None and last == self.END

    def _known(self) -> dict:
        return {who: (mark, at) for who, mark, at in json.loads(self.last.get()[0])} if self.last.exists() else {}

    def _wake(self, at: int) -> None:
        """The bucket's timer stands no later than ``at``."""
        ms = -(-at // 1000)
        if self.timer.exists():
            (old,) = self.timer.get()
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(w, int(a), int(t), m, p) for df in rows for w, a, t, m, p in zip(df["who"], df["at"], df["tie"], df["mark"], df["payload"], strict=True)]
        if self.END is not None:
            over = {who for who, (mark, _) in self._known().items() if self.ended(mark)}
            new = [r for r in new if r[0] not in over]
        if new:
            self.waiting.appendValue((json.dumps(new),))
            self._wake(min(r[1] for r in new))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for (x,) in self.waiting.get() for r in json.loads(x)] if self.waiting.exists() else []
        due = sorted((r for r in rows if r[1] <= now), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2], r[4]))
        known, out = self._known(), []
        for who, group in groupby(due, key=lambda r: r[0]):
            mine = list(group)
            given, mark = self.step(known.get(who, (None, None))[0], mine)
            out += given
            known[who] = mark, mine[-1][1]
        left = [r for r in rows if r[1] > now and not self.ended(known.get(r[0], (None, None))[0])]
        there = len(known)
        if self.keep is not None:
            known = {who: (mark, at) for who, (mark, at) in known.items() if at + self.keep > now}
        if left and len(left) < len(rows):
            self.waiting.put([(json.dumps(left),)])
        elif not left:
            self.waiting.clear()
        if not known:
            self.last.clear()
        elif due or len(known) < there:
            self.last.update((json.dumps([(who, mark, at) for who, (mark, at) in known.items()]),))
        times = [r[1] for r in left] + ([at + self.keep for _, at in known.values()] if self.keep is not None else [])
        if times:
            self._wake(min(times))
        if out:
            yield pd.DataFrame({"payload": out})

    def close(self) -> None:
        pass


class UntilEnd(InOrder):
    """Rows up to and with the first one whose mark says that it ends the key."""

    END = "end"

    def step(self, last: str | None, rows: list[tuple]) -> tuple[list[str], str | None]:
        if self.ended(last):
            return [], last
        ends = next((k for k, r in enumerate(rows) if r[3] == self.END), None)
        given = rows if ends is None else rows[: ends + 1]
        return [r[4] for r in given], given[-1][3]


class Changes(InOrder):
    """Rows whose mark differs from the one before."""

    def step(self, last: str | None, rows: list[tuple]) -> tuple[list[str], str | None]:
        before = [last, *(r[3] for r in rows)]
        return [r[4] for r, b in zip(rows, before, strict=False) if r[3] != b], before[-1]


class Unseen(StatefulProcessor):
    """Rows whose id came neither with the initial state nor in an earlier row, as far as ``keep`` milliseconds of processing time reach back (None: always)."""

    def __init__(self, keep: int | None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "here boolean", self.keep)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for i in initialState["id"]:
            self.seen.updateValue((i,), (True,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for df in rows:
            df = df.drop_duplicates("id")
            fresh = [not self.seen.containsKey((i,)) for i in df["id"]]
            for i in df["id"][fresh]:
                self.seen.updateValue((i,), (True,))
            if any(fresh):
                yield df.loc[fresh, ["payload"]]

    def close(self) -> None:
        pass


def _packed(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), STAMP)


def _unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(F.from_json("payload", like.schema, STAMP).alias("r")).select("r.*")


def in_event_time(stream: DataFrame, processor: InOrder, key: str, time: str, tie: str, mark: Column, delay: str, parts: int = 512) -> DataFrame:
    """``stream`` through ``processor``, each key in order of ``time`` and the whole number ``tie``, across batches.

    Rows may come up to ``delay`` behind the newest one; later ones are dropped. Rows without a time have no place in the order and are left
    out. A row is given out when the watermark has passed it. Keys are dealt to ``parts`` buckets, which hold the state.
    """
    use_rocks(stream.sparkSession)
    at, least = F.unix_micros(F.col(time)), F.lit(-(1 << 63))
    rows = stream.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("__part"), F.col(key).cast("string").alias("who"), F.col(time), at.alias("at"), F.coalesce(F.col(tie).cast("long"), least).alias("tie"), mark.alias("mark"), _packed(stream).alias("payload"))
    return _unpacked(rows.groupBy("__part").transformWithStateInPandas(processor, "payload string", "Append", "EventTime"), stream)


def unseen(stream: DataFrame, known: DataFrame, id_col: str, keep_ms: int | None, parts: int = 64) -> DataFrame:
    """Rows of ``stream`` whose id is neither in ``known`` nor came before. Ids are dealt to ``parts`` keys by hash, so that no scan is a key of its own.

    A null id counts as an id.
    """
    use_rocks(stream.sparkSession)
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    part = F.pmod(F.xxhash64(text), F.lit(parts)).cast("int").alias("part")
    first = known.select(part, text.alias("id")).distinct().groupBy("part")
    rows = stream.select(part, text.alias("id"), _packed(stream).alias("payload")).groupBy("part")
    mode = "None" if keep_ms is None else "ProcessingTime"
    return _unpacked(rows.transformWithStateInPandas(Unseen(keep_ms), "payload string", "Append", mode, first), stream)
