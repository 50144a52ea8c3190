import datetime
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.streaming import streams

EVENTS = "scan_id long, event_id long, event_type string, created_at timestamp"
START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(spark, stream, path, mode="append"):
    """The rows of a stream, by batch, and the finished query."""
    q = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).outputMode(mode)
    q = q.option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").collect(), q


def shuffled(rows, schema_end, files, jitter):
    """Rows in files by time plus up to ``jitter`` minutes, and a last file with a row far ahead."""
    rng = random.Random(4)
    moved = sorted(rows, key=lambda r: (r[-1] or START) + datetime.timedelta(minutes=rng.randint(0, jitter)))
    size = -(-len(moved) // files)
    return [moved[k : k + size] for k in range(0, len(moved), size)] + [[schema_end]]


def until_end(rows):
    want = set()
    for s in {r[0] for r in rows}:
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1])):
            want.add(r[1])
            if r[2] in streams.TERMINAL:
                break
    return want


def test_events_end_with_the_first_terminal_one_across_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randint(0, 4) or None, m, "error" if rng.random() < 0.05 else "progress", at(m // 2)) for m in range(300)]
    for part in shuffled(rows, (-1, -1, "progress", at(10**6)), 8, 30):
        stream = land(spark, tmp_path / "in", part, EVENTS)
    got, q = run(spark, streams.until_terminal(stream, delay="30 minutes", keep=None), tmp_path)
    assert sorted(r["event_id"] for r in got) == sorted(until_end(rows))
    assert len({r["batch"] for r in got}) > 2  # given out as the watermark moves on
    assert streams.late_rows(q) == 0
    for s in {r["scan_id"] for r in got}:
        assert [r["event_id"] for r in sorted((r for r in got if r["scan_id"] == s), key=lambda r: (r["batch"], r["created_at"], r["event_id"]))] == sorted(r["event_id"] for r in got if r["scan_id"] == s)


def test_state_of_ended_scans_is_gone_and_late_rows_are_counted(spark, tmp_path):
    rows = [(s, 10 * s + m, "scan_complete" if m == 3 else "progress", at(60 * s + m)) for s in range(6) for m in range(5)]
    for part in ([r for r in rows if r[0] < 3], [r for r in rows if r[0] >= 3], [(0, 100, "progress", at(1)), (9, 101, "progress", at(2)), (9, 102, None, None)], [(-1, -1, "progress", at(10**6))]):
        stream = land(spark, tmp_path / "in", part, EVENTS)
    got, q = run(spark, streams.until_terminal(stream, delay="10 minutes", keep="1 hour"), tmp_path)
    assert sorted(r["event_id"] for r in got) == sorted(10 * s + m for s in range(6) for m in range(4))
    assert streams.late_rows(q) == 2
    left = q.recentProgress[-1]["stateOperators"][0]
    assert left["numRowsTotal"] <= 4  # the row far ahead with its timer; nothing of the six scans


def test_changes_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randint(0, 3), m, rng.choice(["hunt", "ingest"]), rng.choice(["running", None]), at(m)) for m in range(160)]
    schema = "scan_id long, event_id long, stage string, status string, created_at timestamp"
    args = "scan_id", ["stage", "status"], ["created_at", "event_id"]
    for part in shuffled(rows, (-1, -1, None, None, at(10**6)), 6, 45):
        stream = land(spark, tmp_path / "in", part, schema)
    got, q = run(spark, streams.on_change(stream, *args, delay="45 minutes"), tmp_path)
    want = streams.on_change(spark.createDataFrame(rows, schema), *args).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(map(tuple, want)) and streams.late_rows(q) == 0


def test_snapshot_and_tail_survive_a_restart_and_read_no_sink(spark, tmp_path):
    schema = "scan_id long, event_id long, created_at timestamp"
    snap = spark.createDataFrame([(1, 1, START), (1, 1, START), (2, None, START)], schema)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for rows in ([(1, 1, START), (1, 2, START), (1, 2, START)], [(1, 3, START), (1, 2, START - datetime.timedelta(days=9)), (2, None, START)]):
        q = streams.snapshot_then_tail(snap, land(spark, tmp_path / "in", rows, schema), out, ck)
        q.awaitTermination()
        assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [3]
        snap = snap.unionByName(spark.createDataFrame([(1, 3, START)], schema))  # a later snapshot has what the tail brings; the first one counts
    assert sorted((r["event_id"] or 0) for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    assert spark.read.parquet(out).schema["created_at"].dataType.simpleString() == "timestamp"


def test_seen_ids_leave_after_their_time(spark, tmp_path):
    schema = "scan_id long, event_id long, created_at timestamp"
    snap = spark.createDataFrame([(1, 1, START)], schema)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = land(spark, tmp_path / "in", [(1, 2, START)], schema)
    q = streams.snapshot_then_tail(snap, stream, out, ck, keep="1 second", every="1 second")
    try:
        for part in ([(1, 2, START)], []):
            end = time.time() + 40
            while time.time() < end and spark.read.parquet(out).filter("event_id = 2").count() < 2 - bool(part):
                time.sleep(1)
            time.sleep(3)
            if part:
                land(spark, tmp_path / "in", part, schema)
    finally:
        q.stop()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 2]


@pytest.mark.parametrize("slide", [None, "10 minutes"])
def test_late_rows_are_dropped_from_windows(spark, tmp_path, slide):
    schema = "stage string, created_at timestamp"
    good = [[("a", at(m)) for m in range(0, 60)], [("b", at(m)) for m in range(60, 200)]]
    late = [("late", at(1)), ("late2", at(2))]
    for part in (*good, late + [("a", at(200))], [("end", at(10**6))]):
        stream = land(spark, tmp_path / "in", part, schema)
    got, q = run(spark, streams.event_rates(stream, "30 minutes", slide, "20 minutes"), tmp_path)
    kept = spark.createDataFrame([*good[0], *good[1], ("a", at(200))], schema)
    want = streams.event_rates(kept, "30 minutes", slide).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(map(tuple, want))
    assert streams.late_rows(q) == (6 if slide else 2)  # each of the three windows of a row counts


def test_sessions_close_at_the_watermark(spark, tmp_path):
    schema = "scan_id long, created_at timestamp"
    rows = [(1, at(m)) for m in (0, 10, 50, 55)] + [(2, at(20)), (2, at(100))]
    rows.append((3, at(300)))
    for part in (rows[:3], rows[3:6], rows[6:], [(1, at(1))], [(-1, at(10**6))]):  # a row is late by the watermark of the batch before
        stream = land(spark, tmp_path / "in", part, schema)
    got, q = run(spark, streams.session_rates(stream, "30 minutes", "30 minutes"), tmp_path)
    assert sorted(tuple(r)[:4] for r in got) == sorted(map(tuple, streams.session_rates(spark.createDataFrame(rows, schema), "30 minutes").collect()))
    assert streams.late_rows(q) == 1


def test_streams_equal_batches(spark, tmp_path):
    rows = [(m % 3, m, ("hunt", "ingest")[m % 2], "running", ("high", "low")[m % 2], at(m)) for m in range(40)]
    schema = "scan_id long, event_id long, stage string, status string, severity string, created_at timestamp"
    stream, df = land(spark, tmp_path / "in", rows, schema), spark.createDataFrame(rows, schema)
    for k, of in enumerate((streams.live_counts, streams.stage_state)):
        got = streams.drained(of(stream), spark, str(tmp_path / f"c{k}"), f"drained{k}", "complete")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, of(df).collect()))
    assert sorted(map(tuple, streams.latest_stage(df).collect())) == sorted(map(tuple, streams.stage_state(df).select(*streams.latest_stage(df).columns).collect()))
    assert streams.event_rates(df.withColumn("created_at", F.lit(None).cast("timestamp"))).count() == 0


def test_keys_share_buckets_so_state_does_not_grow_with_them(spark, tmp_path):
    """Three hundred keys that all wait: state is kept by bucket, not by key or row."""
    rows = [(m % 300, m, "error" if m > 560 else "progress", at(m // 100)) for m in range(600)]
    for part in (rows[:300], rows[300:], [(-1, -1, "progress", at(10**6))]):
        stream = land(spark, tmp_path / "in", part, EVENTS)
    work = streams.in_event_time(stream, streams.UntilEnd(None), "scan_id", "created_at", "event_id", F.when(F.col("event_type") == "error", "end"), "1 hour", parts=8)
    got, q = run(spark, work, tmp_path)
    assert sorted(r["event_id"] for r in got) == sorted(until_end(rows))
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 8 * 8


def test_a_row_at_the_second_in_which_the_first_quarter_ends_is_not_late(spark, tmp_path):
    """The quarter of 1019 s is 254 whole seconds; the SQL must not count the row of second 254 either."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_seconds(range) AS ts, range % 7 AS user_id, 'view' AS event_type FROM range(1004)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert con.execute(registry.oracle_sql()["stream_late_rows"]).fetchall() == [(254,)]
    assert [tuple(r) for r in registry.queries()["stream_late_rows"](spark, str(tmp_path)).collect()] == [(254,)]
