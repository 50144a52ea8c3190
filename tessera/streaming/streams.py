"""Structured Streaming over scan events and landing files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import normalize_remote_url
from tessera.operators.detect import scan_secrets
from tessera.operators.findings import SEVERITIES, latest_by
from tessera.sources.corpus import read_push_events
from tessera.streaming.ordered import Changes, UntilEnd, in_event_time, unseen

#: Types of live events, and those that end a scan.
EVENT_TYPES = ("stage_update", "finding_added", "progress", "scan_complete", "error")
TERMINAL = ("scan_complete", "error")
PAYLOAD = "stage:string,status:string,severity:string,message:string,percent:int"


def parse_scan_events(stream: DataFrame, json_col: str = "value") -> DataFrame:
    """Typed events ``scan_id, event_id, event_type, created_at, data`` from JSON lines; unknown types are left out."""
    e = F.from_json(json_col, f"scan_id long, event_id long, event_type string, timestamp timestamp, data struct<{PAYLOAD}>")
    rows = stream.select(e.alias("e")).select("e.scan_id", "e.event_id", "e.event_type", F.col("e.timestamp").alias("created_at"), "e.data")
    return rows.filter(F.col("event_type").isin(*EVENT_TYPES))


def live_counts(stream: DataFrame) -> DataFrame:
    """Findings of each scan by severity so far (update or complete mode)."""
    return stream.groupBy("scan_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def stage_state(stream: DataFrame) -> DataFrame:
    """Newest status of each stage of a scan (update or complete mode)."""
    last = F.max(F.struct("created_at", "event_id", "status")).alias("m")
    return stream.groupBy("scan_id", "stage").agg(last).select("scan_id", "stage", F.col("m.status").alias("status"), F.col("m.created_at").alias("created_at"))


def until_terminal(stream: DataFrame, delay: str = "1 hour", keep: str | None = "1 day") -> DataFrame:
    """Events of a scan up to and with its first terminal one in order of time, across batches (append mode).

    ``stream`` has ``scan_id, event_id, event_type, created_at``; events may come ``delay`` behind the newest one. ``keep`` after a scan's last event, in
    event time, its state is forgotten (None: never).
    """
    rows = stream.select("scan_id", "event_id", "event_type", "created_at")
    mark = F.when(F.col("event_type").isin(*TERMINAL), UntilEnd.END)
    return in_event_time(rows, UntilEnd(_micros(keep)), "scan_id", "created_at", "event_id", mark, delay)


def _micros(span: str | None) -> int | None:
    return None if span is None else int(pd.Timedelta(span).total_seconds() * 1_000_000)


def snapshot_then_tail(snapshot: DataFrame, stream: DataFrame, path: str, checkpoint: str, keep: str | None = None, every: str = "10 seconds"):
    """A started query that writes the snapshot's events, then the stream's without those or repeats, below ``path``.

    The snapshot's ids are the initial state of the stream's, in which ids stay for ``keep`` of processing time, so no batch reads what was
    written. With ``keep`` the query runs a batch ``every`` so often until it is stopped; with None ids stay for good, and it ends when all that is there was read. Each batch overwrites a folder of its own (``batch=<number>``, the snapshot ``batch=-1``), so a batch that runs again writes
    no event twice. The snapshot is that of the first start: a query that starts again goes on from its state.
    """
    done = snapshot.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=-1/_SUCCESS")
    if not done.getFileSystem(snapshot.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(done):
        snapshot.dropDuplicates(["event_id"]).write.mode("overwrite").parquet(f"{path}/batch=-1")
    first = snapshot.sparkSession.read.schema(snapshot.schema).parquet(f"{path}/batch=-1")
    micros = _micros(keep)
    fresh = unseen(stream.select(*snapshot.columns), first, "event_id", None if micros is None else micros // 1000)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"availableNow": True} if keep is None else {"processingTime": every}  # Spark has no last batch while ids can expire
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def on_change(df: DataFrame, key: str, columns: list[str], order: list[str], delay: str = "1 hour", keep: str | None = None) -> DataFrame:
    """Rows in which some of ``columns`` differ from the row before of the same key (the first row too).

    ``order`` is a time and a whole number. A stream is put in that order across batches: rows wait until the watermark, ``delay`` behind the newest
    row, has passed them. The last values of a key are state, which is forgotten after ``keep`` without rows, in event time (None: never).
    """
    if df.isStreaming:
        said = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return in_event_time(df, Changes(_micros(keep)), key, order[0], order[1], said, delay)
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*columns)
    before = F.lag(now).over(w)
    return df.withColumn("__before", before).filter(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(now)).drop("__before")


def scan_requests(push: DataFrame, repos: DataFrame) -> DataFrame:
    """Push events joined with the repositories of their remote URL (stream with static table)."""
    known = repos.select("repo_id", normalize_remote_url(F.col("remote_url")).alias("__url")).groupBy("__url").agg(F.min("repo_id").alias("repo_id"))
    rows = read_push_events(push)
    return rows.withColumn("__url", normalize_remote_url(F.col("clone_url"))).join(known, "__url").select("repo_id", "clone_url", "ref", "commit")


def scan_stream(files: DataFrame) -> DataFrame:
    """Secrets in newly landed files: the stateless batch scan over a stream."""
    return scan_secrets(files)


def event_rates(events: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """Events of each stage in tumbling (or, with ``slide``, sliding) windows; later events than the watermark are dropped from a stream."""
    rows = events.withColumn("created_at", F.col("created_at").cast("timestamp"))
    if watermark and rows.isStreaming:
        rows = rows.withWatermark("created_at", watermark)
    w = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    return rows.groupBy(w.alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "stage", "n")


def session_rates(events: DataFrame, gap: str = "30 minutes", watermark: str | None = "1 hour") -> DataFrame:
    """Sessions of a scan's events: their start, end and size."""
    rows = events.withColumn("created_at", F.col("created_at").cast("timestamp"))
    if watermark and rows.isStreaming:
        rows = rows.withWatermark("created_at", watermark)
    return rows.groupBy(F.session_window("created_at", gap).alias("w"), "scan_id").agg(F.count("*").alias("n")).select("scan_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def late_rows(query) -> int:
    """Rows that a query's stateful operators dropped behind the watermark, by its own progress.

    In windowed counts Spark drops what each task has pre-aggregated: rows of one window and key that a task reads in one batch are one. Batches beyond
    ``spark.sql.streaming.numRecentProgressUpdates`` are forgotten.
    """
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def drained(query_of, spark, checkpoint: str, name: str, mode: str) -> DataFrame:
    """Run a stream over all that is there and return its result from memory (for tests and small results)."""
    q = query_of.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def latest_stage(events: DataFrame) -> DataFrame:
    """The batch counterpart of ``stage_state``."""
    return latest_by(events.select("scan_id", "stage", "created_at", "event_id", "status"), ["scan_id", "stage"], "created_at", "event_id").drop("event_id")
