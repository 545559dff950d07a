"""Streaming runs over the events table, drained to completion."""

from pyspark.sql import functions as F

from eventloom.plans.registry import query
from eventloom.plans.standins import DAY_MS, EPOCH_MS
from eventloom.streaming import jobs


def _events(x):
    """The events table as a file stream."""
    # Spark reads the zone-free parquet time as UTC under the session zone
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = x.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(x.sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _closed(x):
    """The events stream with ``is_end``, and the end that closes it once the table is read."""
    end = jobs.EndOfInput(x.spark, "ts")
    return end.after(_events(x)), end


@query("S1_interval_counts", """SELECT CAST(epoch_us(ts) // 30000000 * 30000 - 1704067200000 AS BIGINT) AS start_ms, event_type, count(*) AS events FROM events GROUP BY 1, 2""")
def interval_counts(x):
    """Counts of every 30-second window of the table; the closing row lets the last ones out."""
    e, end = _closed(x)
    out = jobs.drain(jobs.interval_counts(e, "ts", "event_type", "30 seconds", "10 minutes"), end=end)
    return out.select((F.unix_millis("start") - EPOCH_MS).alias("start_ms"), "event_type", "events")


@query("S2_kill_groups", """WITH e AS (SELECT event_id, user_id AS match, CAST(epoch_us(ts) // 1000 - 1704067200000 AS BIGINT) AS t, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) // 34 AS who, event_type AS et FROM events WHERE event_type IN ('click', 'view', 'purchase')),
q AS (SELECT *, row_number() OVER (PARTITION BY match ORDER BY t, event_id) AS n FROM e),
p AS (SELECT *, min(CASE WHEN et = 'purchase' THEN n END) OVER (PARTITION BY match ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mk FROM q),
r AS (SELECT p.match, mm.event_id AS marker, mm.t, mm.who AS victim, list(p.who ORDER BY p.n) AS ids FROM p JOIN q mm ON mm.match = p.match AND mm.n = p.mk WHERE p.et <> 'purchase' AND mm.t - p.t <= 86400000 GROUP BY 1, 2, 3, 4)
SELECT match, marker, t, victim, CASE WHEN len(ids) = 1 THEN 0 ELSE ids[-1] END AS killer, len(ids) AS owners, CASE WHEN ids[1] = victim THEN 'ok' ELSE 'victim-mismatch' END AS code FROM r""")
def kill_groups(x):
    """Every group of every match, in order of time; the closing row lets the watermark pass the last marker."""
    e, end = _closed(x)
    t = F.unix_millis("ts") - EPOCH_MS
    who = F.coalesce(F.floor(F.get_json_object("props", "$.k").cast("long") / 34), F.lit(0).cast("long"))
    rows = e.filter(F.col("event_type").isin("click", "view", "purchase") | F.col("is_end")).select(
        F.coalesce("user_id", F.lit(-1).cast("long")).alias("match"), "ts", F.coalesce("event_id", F.lit(-1).cast("long")).alias("event_id"), t.alias("t"), who.alias("who"),
        (~F.col("is_end") & (F.col("event_type") == "purchase")).alias("is_marker"),
    )
    return jobs.drain(jobs.kill_groups(rows, "match", "ts", "10 minutes", DAY_MS), end=end)


@query("S3_running_totals", """SELECT user_id, event_type, count(*) AS events, CAST(epoch_us(max(ts)) // 1000 - 1704067200000 AS BIGINT) AS last_ms, R6(max_by(value, (ts, value))) AS last_value FROM events GROUP BY 1, 2""")
def running_totals(x):
    out = jobs.drain(jobs.running_totals(_events(x), ["user_id", "event_type"], "ts", "value"), "update")
    latest = out.groupBy("user_id", "event_type").agg(F.max_by(F.struct("events", "last_t", "last_value"), "_batch").alias("r"))
    return latest.select("user_id", "event_type", "r.events", (F.unix_millis("r.last_t") - EPOCH_MS).alias("last_ms"), "r.last_value")


@query("S4_lifecycle_stream", """WITH p AS (SELECT user_id, event_id AS placed_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, ts AS rts FROM events WHERE event_type = 'error'),
u AS (SELECT p.*, rts FROM p LEFT JOIN r ON p.user_id = r.user_id AND rts BETWEEN p.ts AND p.ts + INTERVAL 2 HOUR)
SELECT user_id, placed_id, CAST(epoch_us(ts) // 1000 - 1704067200000 AS BIGINT) AS placed_ms, CAST(epoch_us(rts) // 1000 - 1704067200000 AS BIGINT) AS removed_ms FROM u""")
def lifecycle_stream(x):
    """Placements with removals within two hours; every placement without one comes out, the last ones by the closing row."""
    e, end = _closed(x)
    # the closing row needs a key on both sides, or the join drops it before the watermark; -1 and -2 never meet
    placed = e.filter("event_type = 'signup' OR is_end").select(F.coalesce("user_id", F.lit(-1).cast("long")).alias("user_id"), F.col("event_id").alias("placed_id"), F.col("ts").alias("placed_ts"))
    removed = e.filter("event_type = 'error' OR is_end").select(F.coalesce("user_id", F.lit(-2).cast("long")).alias("user_id"), F.col("ts").alias("removed_ts"))
    out = jobs.drain(jobs.lifecycle_join(placed, removed, ["user_id"], "10 minutes", "2 hours"), end=end)
    return out.select("user_id", "placed_id", (F.unix_millis("placed_ts") - EPOCH_MS).alias("placed_ms"), (F.unix_millis("removed_ts") - EPOCH_MS).alias("removed_ms"))
