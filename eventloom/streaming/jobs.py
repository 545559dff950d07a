"""Streaming jobs with explicit watermarks.

Late rows behind the watermark are dropped; that policy is ours, the batch operators have no
late data. A stream over a whole table is closed by ``EndOfInput``, so its tail comes out. Sinks are files: nothing streams through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.session import checkpoint_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the start of one query, which keeps a copy of it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class EndOfInput:
    """Closes a stream that has an end, so that what waits behind the watermark comes out.

    ``after`` adds a second file source to a stream, silent at first. ``close`` writes one row to it, with
    an event time beyond all others and nulls elsewhere; the watermark then passes every row of the input.
    The row itself (``is_end``) stays behind the watermark: it is never part of a result.
    """

    def __init__(self, spark: SparkSession, ts: str, beyond: str = "2262-01-01 00:00:00"):
        self.spark, self.ts, self.beyond = spark, ts, beyond
        self.folder = f"{work_folder(spark)}/end"
        self.schema = None

    def after(self, stream: DataFrame) -> DataFrame:
        self.schema = stream.schema
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)
        end = self.spark.readStream.schema(self.schema).parquet(self.folder)
        return stream.withColumn("is_end", F.lit(False)).unionByName(end.withColumn("is_end", F.lit(True)))

    def close(self) -> None:
        row = [F.lit(self.beyond if f.name == self.ts else None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        self.spark.range(1).select(*row).write.mode("append").parquet(self.folder)


def drain(stream: DataFrame, mode: str = "append", end: EndOfInput | None = None) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    With ``end`` the stream is then closed: the same query goes on from its checkpoint over the closing row.
    ``update`` results carry the batch id in ``_batch`` so the caller can keep the latest.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)
    out = f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode(mode)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b{batch_id}")

    with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        run = (lambda: writer.format("parquet").start(out)) if mode == "append" else (lambda: writer.foreachBatch(keep).start())
        run().awaitTermination()
        if end is not None:
            end.close()
            run().awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("_batch", "long")
    reader = spark.read.schema(schema)
    return reader.parquet(out) if mode == "append" else reader.option("recursiveFileLookup", "true").parquet(out)


def interval_counts(events: DataFrame, ts: str, kind: str, width: str, delay: str) -> DataFrame:
    """Event counts per tumbling window and type."""
    w = F.window(ts, width)
    out = events.withWatermark(ts, delay).groupBy(w.alias("w"), kind).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "events")


def running_totals(events: DataFrame, keys, ts: str, value: str) -> DataFrame:
    """Running totals and the latest value per entity (update mode)."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"), F.max(F.struct(ts, value)).alias("latest")
    ).select(*keys, "events", F.col(f"latest.{ts}").alias("last_t"), F.col(f"latest.{value}").alias("last_value"))


def lifecycle_join(placed: DataFrame, removed: DataFrame, keys, delay: str, horizon: str) -> DataFrame:
    """Placement with removals after it within the horizon; placements without one come out null.

    ``placed``: keys, placed_id, placed_ts. ``removed``: the same keys, removed_ts.
    """
    p = placed.withWatermark("placed_ts", delay).alias("p")
    r = removed.withWatermark("removed_ts", delay).alias("r")
    cond = F.expr(f"r.removed_ts >= p.placed_ts AND r.removed_ts <= p.placed_ts + interval {horizon}")
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"r.{k}"))
    return p.join(r, cond, "leftOuter").select(*[F.col(f"p.{k}").alias(k) for k in keys], "placed_id", "placed_ts", "removed_ts")


OUT = ["match", "marker", "t", "victim", "killer", "owners", "code"]
#: What waits in state, eight-byte integers for each event; ``lost`` marks a null match.
CELLS = ["lost", "match", "t", "event_id", "who", "is_marker", "at"]


class KillGroups:
    """Pending owners per match, closed by a marker; owners older than the tolerance are let go.

    Rows wait in state until the watermark has passed them, so they are folded in order of time
    however batches and Arrow chunks cut them. What has become final is settled whenever the state is called;
    a timeout calls it for what still waits. When nothing is left within the tolerance, no state stays behind. A
    state is two blobs (waiting, pending) of the rows of a bucket of matches, as every call costs milliseconds.
    """

    STATE = "waiting binary, pending binary"

    def __init__(self, tolerance: int):
        self.tolerance = tolerance

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, pending = (np.frombuffer(b, np.int64).reshape(-1, len(CELLS)) for b in (state.get if state.exists else (b"", b"")))
        if not state.hasTimedOut:
            waiting = np.concatenate([waiting, *[np.stack([pdf[c].to_numpy(np.int64) for c in CELLS], axis=1) for pdf in rows]])
        final, out = state.getCurrentWatermarkMs(), []
        ready = waiting[:, -1] <= final
        settled, waiting = waiting[ready], waiting[~ready]
        held: dict[tuple[int, int], list[list[int]]] = {}
        for row in pending.tolist():
            held.setdefault((row[0], row[1]), []).append(row)
        for row in settled[np.lexsort(settled.T[::-1])].tolist():
            lost, match, t, ident, who, marker, _ = row
            own = [h for h in held.get((lost, match), []) if t - h[2] <= self.tolerance]
            if not marker:
                held[lost, match] = [*own, row]
                continue
            if own:
                ids = [h[4] for h in own]
                out.append((None if lost else match, ident, t, who, 0 if len(ids) == 1 else ids[-1], len(ids), "ok" if ids[0] == who else "victim-mismatch"))
            held.pop((lost, match), None)
        left = [h for own in held.values() for h in own if final - h[-1] <= self.tolerance]
        due = [*waiting[:, -1].tolist(), *[h[-1] + self.tolerance for h in left]]
        if due:
            state.update((waiting.tobytes(), np.array(left, np.int64).tobytes()))
            state.setTimeoutTimestamp(min(due) + 1)
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=OUT).astype({"match": "Int64"})


def kill_groups(events: DataFrame, match: str, ts: str, delay: str, tolerance: int, buckets: int = 2048) -> DataFrame:
    """Marker-terminated groups of a match; ``events`` has match, event time, event_id, t, who, is_marker.

    A row without a time is never reached by the watermark, so it counts for nothing. Matches are dealt over
    ``buckets`` states; a stream that goes on from a checkpoint must keep their number.
    """
    m = F.col(match)
    rows = events.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        F.pmod(F.xxhash64(m), F.lit(buckets)).alias("bucket"), m.isNull().alias("lost"), F.coalesce(m.cast("long"), F.lit(0)).alias("match"),
        "t", "event_id", "who", "is_marker", F.unix_millis(ts).alias("at"), ts,
    )
    return rows.groupBy("bucket").applyInPandasWithState(
        KillGroups(tolerance), "match long, marker long, t long, victim long, killer long, owners long, code string",
        KillGroups.STATE, "append", GroupStateTimeout.EventTimeTimeout,
    )
