"""Window and sequence operators built on ordered scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import stats as s
from eventloom.operators import ordered as o
from eventloom.operators import timejoin as tj


def field_changes(df, keys, order, block, value: str, is_float: Column) -> DataFrame:
    """Rows whose value moved by more than the decode's epsilon (0 for integers)."""
    out = o.scan(df, keys, order, block, {"_p": o.prev(value)})
    eps = F.when(is_float, F.greatest(F.lit(1e-3), F.abs("_p") * 1e-6)).otherwise(0.0)
    out = out.withColumn("delta", F.col(value) - F.col("_p"))
    return out.filter(F.abs("delta") > eps).drop("_p")


def transitions(df, keys, order, block, index: str, cols: Sequence[str]) -> DataFrame:
    """Consecutive snapshots side by side with a contiguity flag."""
    out = o.scan(df, keys, order, block, {"_p": o.prev(F.struct(*[F.col(c) for c in [index, *cols]]))})
    out = out.filter(F.col("_p").isNotNull())
    out = out.withColumns({f"before_{c}": F.col(f"_p.{c}") for c in cols})
    return out.withColumn("contiguous", F.col(index) == F.col(f"_p.{index}") + 1).drop("_p")


def cumulative_counts(df, keys, order, block, t: str, flags: Mapping[str, Column], last: tuple[str, Column]) -> DataFrame:
    """Running count per flag up to and including each row, and the last time of one flag."""
    name, cond = last
    outputs = {n: o.run_count(c) for n, c in flags.items()}
    outputs[name] = o.last_seen(F.when(cond, F.col(t)))
    return o.scan(df, keys, order, block, outputs)


def latest_at(df, keys, t: str, at: int, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Latest row at or before ``at`` per key; the first row when none is that early."""
    spot = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in [t, *cols]])
    past = F.col(t) <= at
    pick = F.coalesce(F.max_by(F.when(past, row), F.when(past, spot)), F.min_by(row, spot))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def life_flags(df, keys, order, block, t: str, health: Column, death: Column) -> DataFrame:
    """isDead, died in the last minute, and back alive since the previous row."""
    df = df.withColumn("_h", health)
    out = o.scan(df, keys, order, block, {"_ph": o.prev("_h"), "_ld": o.last_seen(F.when(death, F.col(t)))})
    return out.withColumns(
        {
            "is_dead": F.when(F.col("_h") <= 0, 1).otherwise(0),
            "recent_death": F.when(F.col(t) - F.col("_ld") <= 60_000, 1).otherwise(0),
            "respawned": F.when((F.col("_ph") <= 0) & (F.col("_h") > 0), 1).otherwise(0),
        }
    ).drop("_h", "_ph", "_ld")


def marker_state(lives: DataFrame, at: int, pulse: int, placed: str, removed: str) -> DataFrame:
    """State of a placed marker at a time: removal pulse, then placement pulse, then active.

    Unlinked placements (no removal) pulse when placed but are never active.
    """
    p, r = F.col(placed), F.col(removed)
    gone = r.isNotNull() & (r <= at) & (F.lit(at) - r <= pulse)
    fresh = (p <= at) & (F.lit(at) - p <= pulse)
    active = r.isNotNull() & (p <= at) & (r > at)
    return lives.withColumn(
        "state", F.when(gone, "removal_pulse").when(fresh, "placement_pulse").when(active, "active").otherwise("hidden")
    )


def slot_clusters(df, keys, slot: str, max_gap: int, weight: str) -> DataFrame:
    """Islands of slots whose gaps are at most ``max_gap``, with summed weight."""
    per = df.repartition(o.task_count(df), *keys).groupBy(*keys, slot).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    runs = o.gap_islands(per, keys, slot, [slot], None, max_gap, "cluster")
    return runs.groupBy(*keys, "cluster").agg(
        F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"), F.count("*").alias("slots"),
        F.sum("_n").alias("entries"), F.sum("_w").alias("weight"),
    )


def probe_samples(df, keys, order, block, probes: int) -> DataFrame:
    """Rows at evenly spaced positions of each key: round(i*(n-1)/(probes-1)), or all if fewer."""
    placed = o.position(df, keys, order, block, "_rn")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    spots = F.transform(
        F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (probes - 1) + 0.5) + 1
    )
    spots = F.when(F.col("_n") <= probes, F.sequence(F.lit(1).cast("long"), F.col("_n"))).otherwise(F.array_distinct(spots.cast("array<long>")))
    wanted = sizes.select(*keys, F.explode(spots).alias("_rn"))
    return placed.join(wanted, [*keys, "_rn"], "left_semi").drop("_rn")


def edge_values(df, keys, order, value: str) -> DataFrame:
    """First, last and last finite value per key."""
    spot = F.struct(*[F.col(c) for c in order])
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.groupBy(*keys).agg(
        F.min_by(value, spot).alias("first_value"), F.max_by(value, spot).alias("last_value"),
        F.max_by(F.when(finite, v), F.when(finite, spot)).alias("last_finite"), F.count("*").alias("samples"),
    )


def byte_layout(df, keys, start: str, end: str, ident: str, block=None) -> DataFrame:
    """Regions of a container: each segment's header and payload, and the gaps between segments.

    A gap is the space between a segment and the furthest end before it.
    """
    out = o.scan(df, keys, [start, ident], block, {"_before": o.max_before(end)})
    gap = F.when(F.col(start) > F.coalesce("_before", F.lit(0)), F.coalesce("_before", F.lit(0)))
    parts = F.array(
        F.struct(F.lit("gap").alias("kind"), gap.alias("from"), F.col(start).alias("to")),
        F.struct(F.lit("segment").alias("kind"), F.col(start).alias("from"), F.col(end).alias("to")),
    )
    out = out.select(*keys, ident, F.explode(parts).alias("_p")).select(*keys, ident, "_p.*")
    return out.filter(F.col("from").isNotNull())


def same_time_groups(df, keys, order, block, t: str, name: str = "group_no") -> DataFrame:
    """Number runs of equal consecutive times."""
    starts = F.col("_pt").isNull() | (F.col("_pt") != F.col(t))
    return o.islands(df, keys, order, block, starts, name, {"_pt": t})


def monotone_check(df, keys, order, block, cols: Sequence[str]) -> DataFrame:
    """Count of falls per column along the order."""
    out = o.scan(df, keys, order, block, {f"_p_{c}": o.prev(c) for c in cols})
    return out.groupBy(*keys).agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c) < F.col(f"_p_{c}")).alias(f"{c}_falls") for c in cols]
    )


def nearby(df, keys, t: str, at: int, radius: int, k: int, tie: str) -> DataFrame:
    """Events within the radius of a time, or all when none is; the ``k`` nearest, in time order."""
    away = F.abs(F.col(t) - at)
    hits = df.groupBy(*keys).agg(F.count_if(away <= radius).alias("_near"))
    out = df.join(hits, list(keys)).filter((F.col("_near") == 0) | (away <= radius)).drop("_near")
    return o.top_k(out, keys, [away.asc(), F.asc(t), F.asc(tie)], k)


def plausible_series(df, keys, order, block, value: str, low: float, high: float, jump: float) -> DataFrame:
    """.7 in-range + .3 non-falling share, cut by the share of jumps beyond the limit."""
    out = o.scan(df, keys, order, block, {"_p": o.prev(value)})
    d = F.col(value) - F.col("_p")
    n = F.count("_p")
    in_range = s.ratio(F.col(value).between(low, high))
    rising = F.when(n > 0, F.count_if(d >= -1e-6) / n).otherwise(1.0)
    jumps = F.coalesce(F.try_divide(F.count_if(F.abs(d) > jump), n), F.lit(0.0))
    penalty = F.when(jumps > 0, F.greatest(F.lit(0.22), 1 - 1.35 * jumps)).otherwise(1.0)
    return out.groupBy(*keys).agg(((0.7 * in_range + 0.3 * rising) * penalty).alias("plausibility"))


def field_summary(df, keys, order, block, value: str) -> DataFrame:
    """Samples, unique values, changed transitions, range and an archetype.

    The inner scoring of the archetype is ours: *static* without change, *dynamic* when at
    least half of the transitions change, *mixed* otherwise.
    """
    out = o.scan(df, keys, order, block, {"_p": o.prev(value)})
    changed = F.count_if(F.col("_p").isNotNull() & (F.col(value) != F.col("_p")))
    steps = F.count("_p")
    return out.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count_distinct(value).alias("unique_values"), steps.alias("transitions"),
        changed.alias("changed"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.when(changed == 0, "static").when(changed >= steps / 2, "dynamic").otherwise("mixed").alias("archetype"),
    )


def position_profile(df, keys, order, block, x: str, y: str, smooth: float, moving: float) -> DataFrame:
    """Smooth and moving step counts per slot, with a class.

    Thresholds are ours: *smooth* when 80 % of steps are short, *moving* when 20 % of steps
    exceed the movement threshold, else *still*.
    """
    out = o.scan(df, keys, order, block, {"_px": o.prev(x), "_py": o.prev(y)})
    step = F.sqrt(F.pow(F.col(x) - F.col("_px"), F.lit(2.0)) + F.pow(F.col(y) - F.col("_py"), F.lit(2.0)))
    n, short, far = F.count(step), F.count_if(step <= smooth), F.count_if(step >= moving)
    return out.groupBy(*keys).agg(
        F.count("*").alias("samples"), short.alias("smooth_steps"), far.alias("moving_steps"),
        F.when(short >= 0.8 * n, "smooth").when(far >= 0.2 * n, "moving").otherwise("still").alias("class"),
    )


def dedupe(df, keys, order: Sequence[Column]) -> DataFrame:
    return o.best(df, keys, order)


def canonical(df, keys, order: Sequence[Column], ident: str) -> DataFrame:
    """Canonical row id per key and the discarded alias rows pointing to it."""
    spot = F.struct(*[F.col(c) for c in order])
    head = df.groupBy(*keys).agg(F.min_by(ident, spot).alias("canonical"), F.count("*").alias("members"))
    return df.join(head, list(keys)).withColumn("is_alias", F.col(ident) != F.col("canonical"))


def strict_order(df, keys, order, block, cols: Sequence[str]) -> DataFrame:
    """Count of rows not strictly after their predecessor on the composite order."""
    now = F.struct(*[F.col(c) for c in cols])
    out = o.scan(df, keys, order, block, {"_p": o.prev(now)})
    return out.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(F.col("_p").isNotNull() & ~(F.col("_p") < now)).alias("violations")
    )


def partition_assertion(whole: DataFrame, parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Rows missing from every part, foreign to the whole, or in several parts."""
    seen = None
    for name, part in parts.items():
        piece = part.select(key).distinct()
        seen = piece if seen is None else seen.unionAll(piece)
    hits = seen.groupBy(key).agg(F.count("*").alias("parts"))
    base = whole.select(key).distinct().withColumn("_w", F.lit(True))
    return base.join(hits, key, "full").select(
        key,
        F.when(F.col("_w").isNull(), "foreign").when(F.col("parts").isNull(), "uncovered").when(F.col("parts") > 1, "overlap").otherwise("ok").alias("status"),
    )


def discovery_split(df, group: str, order: Sequence[str], name: str = "partition") -> DataFrame:
    """Last ceil(n/3) members of each group are hold-out, the rest discovery."""
    placed = o.position(df, [group], order, None, "_rn")
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    out = placed.join(sizes, group)
    hold = F.col("_rn") > F.col("_n") - F.ceil(F.col("_n") / 3)
    return out.withColumn(name, F.when(hold & (F.col("_n") > 1), "holdout").otherwise("discovery")).drop("_rn", "_n")
