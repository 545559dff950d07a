"""Stateful streaming over several micro-batches and small Arrow chunks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from eventloom.streaming import jobs

START = dt.datetime(2024, 1, 1)
TOLERANCE = 60_000


def test_kill_groups_over_micro_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = [(m, i, i * 7_000 + rng.randint(0, 20_000), rng.randint(0, 2), rng.random() < 0.3) for i in range(240) for m in (rng.randint(1, 3),)]
    rows.append((9, 999, 240 * 7_000 + 3_600_000, 0, False))  # moves the watermark past all others
    for part in range(3):
        some = [r for k, r in enumerate(rows) if k * 3 // len(rows) == part]
        df = spark.createDataFrame([(*r, START + dt.timedelta(milliseconds=r[2])) for r in some], "match long, event_id long, t long, who long, is_marker boolean, ts timestamp")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        schema = "match long, event_id long, t long, who long, is_marker boolean, ts timestamp, part int"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
        got = jobs.drain(jobs.kill_groups(stream, "match", "ts", "30 seconds", TOLERANCE)).orderBy("match", "marker").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    want = []
    for match in (1, 2, 3):
        held = []
        for _, ident, t, who, marker in sorted((r for r in rows if r[0] == match), key=lambda r: (r[2], r[1])):
            held = [h for h in held if t - h[0] <= TOLERANCE]
            if marker and held:
                ids = [h[1] for h in held]
                want.append((match, ident, t, who, 0 if len(ids) == 1 else ids[-1], len(ids), "ok" if ids[0] == who else "victim-mismatch"))
            held = [] if marker else [*held, (t, who)]
    assert [tuple(r) for r in got] == sorted(want)


def test_interval_counts_close_behind_the_watermark(spark, tmp_path):
    rows = [(START + dt.timedelta(seconds=s), "a" if s % 2 else "b") for s in range(0, 300, 5)]
    spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in"))
    out = jobs.drain(jobs.interval_counts(stream, "ts", "kind", "30 seconds", "60 seconds"))
    closed = START + dt.timedelta(seconds=295 - 60)
    assert out.agg(F.max("end")).first()[0] <= closed and out.agg(F.sum("events")).first()[0] == sum(t < START + dt.timedelta(seconds=210) for t, _ in rows)


def test_closing_row_lets_the_tail_out(spark, tmp_path):
    rows = [(START + dt.timedelta(seconds=s), "a" if s % 2 else "b") for s in range(0, 300, 5)]
    spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    end = jobs.EndOfInput(spark, "ts")
    stream = end.after(spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in")))
    out = jobs.drain(jobs.interval_counts(stream, "ts", "kind", "30 seconds", "60 seconds"), end=end)
    want = {}
    for t, kind in rows:
        key = (START + dt.timedelta(seconds=(t - START).seconds // 30 * 30), kind)
        want[key] = want.get(key, 0) + 1
    assert {(r.start, r.kind): r.events for r in out.collect()} == want


def test_kill_groups_in_few_buckets(spark, tmp_path):
    """Many matches share a state, a null match is one of them, and a row without a time counts for nothing."""
    rows = [(m, 10 * (m or 0) + k, 1000 * k, k, k == 3) for m in [None, *range(40)] for k in range(4)]
    made = [(*r, START + dt.timedelta(milliseconds=r[2])) for r in rows] + [(7, 999, 0, 0, True, None), (50, 1000, 9_000_000, 0, False, START + dt.timedelta(hours=9))]
    schema = "match long, event_id long, t long, who long, is_marker boolean, ts timestamp"
    spark.createDataFrame(made, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = jobs.drain(jobs.kill_groups(stream, "match", "ts", "30 seconds", TOLERANCE, buckets=3)).collect()
    want = [(m, 10 * (m or 0) + 3, 3000, 3, 2, 3, "victim-mismatch") for m in [None, *range(40)]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
