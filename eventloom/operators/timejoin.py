"""Time-alignment joins without inequality joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import ordered as o

L, R = "_left", "_right"
DAY_MS = 86_400_000


def _sides(left: DataFrame, right: DataFrame, keys, left_t: str, right_t: str, tie: str) -> DataFrame:
    """Stack both sides into one ordered stream; payloads ride in structs."""
    right_t_col = F.col(right_t).alias("t")
    lhs = left.select(
        *keys,
        F.col(left_t).alias("_t"),
        F.lit(1).alias("_side"),
        F.monotonically_increasing_id().cast("string").alias("_tie") if tie is None else F.col(tie).alias("_tie"),
        F.struct(*[F.col(c) for c in left.columns]).alias(L),
        F.lit(None).cast(f"struct<{_struct_ddl(right)}>").alias(R),
    )
    rhs = right.select(
        *keys,
        right_t_col.alias("_t"),
        F.lit(0).alias("_side"),
        F.col(tie).alias("_tie") if tie in right.columns else F.lit(None).alias("_tie"),
        F.lit(None).cast(f"struct<{_struct_ddl(left)}>").alias(L),
        F.struct(*[F.col(c) for c in right.columns]).alias(R),
    )
    return lhs.unionByName(rhs)


def _struct_ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema.fields)


def neighbours(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t: str,
    tie: str,
    block_ms: int | None,
    backward: str | None = "before",
    forward: str | None = "after",
    strict_forward: bool = True,
) -> DataFrame:
    """Attach the latest right row at or before each left row and the earliest one after it.

    Both frames hold ``keys``, ``t`` and the unique ``tie``. Equal times count as
    *before*; with ``strict_forward=False`` the forward neighbour may share the time.
    Output: the left columns plus struct columns named by ``backward`` and ``forward``.
    """
    keys = list(keys)
    both = _sides(left, right, keys, t, t, tie)
    block = o.time_block("_t", block_ms) if block_ms else None
    outputs = {}
    if backward:
        outputs[backward] = o.last_seen(R)
    if forward:
        outputs[forward] = o.next_seen(R)
    order = ["_t", "_side", "_tie"]
    if forward and not strict_forward:
        # equal times must also be visible forward: a second pass with sides swapped
        out = o.scan(both, keys, order, block, {k: v for k, v in outputs.items() if k != forward}) if backward else both
        out = out.withColumn("_side2", -F.col("_side"))
        out = o.scan(out, keys, ["_t", "_side2", "_tie"], block, {forward: outputs[forward]})
    else:
        out = o.scan(both, keys, order, block, outputs)
    out = out.filter(F.col(L).isNotNull())
    extra = [c for c in (backward, forward) if c]
    return out.select(*[F.col(f"{L}.{c}").alias(c) for c in left.columns], *extra)


def nearest(left, right, keys, t, tie, block_ms, tolerance: int | None = None, later_wins: bool = False) -> DataFrame:
    """Left rows with the closest right row in time as struct ``near`` and ``delta``.

    Earlier wins ties unless ``later_wins``. Without one inside the tolerance ``near`` is null.
    """
    out = neighbours(left, right, keys, t, tie, block_ms)
    back = F.col(t) - F.col(f"before.{t}")
    fwd = F.col(f"after.{t}") - F.col(t)
    forward_better = (fwd <= back) if later_wins else (fwd < back)
    take_forward = F.col("after").isNotNull() & (F.col("before").isNull() | forward_better)
    out = out.withColumn("near", F.when(take_forward, F.col("after")).otherwise(F.col("before")))
    out = out.withColumn("delta", F.abs(F.col(f"near.{t}") - F.col(t)))
    if tolerance is not None:
        ok = F.col("delta") <= tolerance
        out = out.withColumn("near", F.when(ok, F.col("near"))).withColumn("delta", F.when(ok, F.col("delta")))
    return out.drop("before", "after")


def interpolate(left, right, keys, t, tie, block_ms, values: Sequence[str], prefix: str = "at_") -> DataFrame:
    """Right ``values`` at each left time: linear, clamped at the ends, right value on zero spans."""
    out = neighbours(left, right, keys, t, tie, block_ms)
    t0, t1 = F.col(f"before.{t}"), F.col(f"after.{t}")
    share = (F.col(t) - t0).cast("double") / (t1 - t0)
    cols = []
    for v in values:
        a, b = F.col(f"before.{v}").cast("double"), F.col(f"after.{v}").cast("double")
        cols.append(
            F.when(F.col("before").isNull(), b)
            .when(F.col("after").isNull(), a)
            .when(F.col(t) == t0, a)
            .otherwise(a + (b - a) * share)
            .alias(prefix + v)
        )
    return out.select(*left.columns, *cols)


def within(left, right, keys, t, tolerance: int, right_prefix: str = "r_") -> DataFrame:
    """All pairs with |Δt| ≤ tolerance, by time-bucket equi-join.

    A bucket is ``tolerance+1`` wide, so a left row meets three right buckets. A hot key
    spreads over its buckets; pairs outside the tolerance never leave the join.
    """
    keys, width = list(keys), tolerance + 1
    renamed = right.select(*keys, *[F.col(c).alias(right_prefix + c) for c in right.columns if c not in keys])
    b = o.time_block(t, width)
    lhs = left.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    rhs = renamed.withColumn("_b", o.time_block(right_prefix + t, width))
    near = F.abs(F.col(t) - F.col(right_prefix + t)) <= tolerance
    return lhs.join(rhs, [*keys, "_b"]).filter(near).drop("_b")


def window_counts(left, right, keys, t, ident: str, tolerance: int, name: str) -> DataFrame:
    """(keys, ident, name): how many right rows lie within the tolerance of each left row, without pairs.

    The count is a difference of two readings of one running count, taken just before and just
    after the window; every left row adds two marks, however dense the right side is.
    """
    keys = list(keys)
    marks = right.select(*keys, F.col(t).alias("_at"), F.lit(1).alias("_rank"), F.col(ident).alias("_id"), F.lit(1).cast("long").alias("_one"))
    for shift, rank in ((-tolerance, 0), (tolerance, 2)):
        marks = marks.unionByName(left.select(*keys, (F.col(t) + shift).alias("_at"), F.lit(rank).alias("_rank"), F.col(ident).alias("_id"), F.lit(0).cast("long").alias("_one")))
    run = o.scan(marks, keys, ["_at", "_rank", "_id"], o.time_block("_at", 8 * (tolerance + 1)), {"_n": o.run_sum("_one")})
    ends = [F.max(F.when(F.col("_rank") == rank, F.col("_n"))) for rank in (2, 0)]
    return run.filter("_rank <> 1").groupBy(*keys, F.col("_id").alias(ident)).agg((ends[0] - ends[1]).alias(name))


def covered(rows, keys, t, tolerance: int) -> DataFrame:
    """(keys, lo, hi): the disjoint intervals of times within the tolerance of some row of the key."""
    keys = list(keys)
    runs = o.gap_islands(rows.select(*keys, t).distinct(), keys, t, [t], o.time_block(t, 8 * (tolerance + 1)), 2 * tolerance, "_run")
    return runs.groupBy(*keys, "_run").agg((F.min(t) - tolerance).alias("lo"), (F.max(t) + tolerance).alias("hi")).drop("_run")


def interval_stats(intervals, points, keys, names: Sequence[str], t, ident: str, value: str | None = None, block_ms: int = DAY_MS) -> DataFrame:
    """How many points of its key lie in each interval, the value of the first one, and whether all have it.

    ``intervals`` has keys, names, lo and hi (both inclusive), disjoint for the same keys and names; ``points`` has
    keys, t, ident and the value. All is read off running sums (points, changes of value) at the two ends
    of an interval, so no pairs are made. Intervals without points stay, with n = 0.
    """
    keys, names = list(keys), list(names)
    own = F.col(value) if value is not None else F.lit(0)
    spots = points.select(*keys, F.col(t).alias("_at"), F.col(ident).alias("_tie"), own.alias("_value"))
    spots = o.scan(spots, keys, ["_at", "_tie"], o.time_block("_at", block_ms), {"_prev": o.prev(F.struct("_value"))})
    turn = F.when(F.col("_prev").isNull() | ~F.col("_prev._value").eqNullSafe(F.col("_value")), 1).otherwise(0).cast("long")
    who, kinds = F.struct(*names, F.col("lo").alias("_lo")), spots.schema
    zero, none = F.lit(0).cast("long"), F.lit(None).cast(kinds["_tie"].dataType)
    rows = spots.select(*keys, "_at", F.lit(1).alias("_rank"), "_tie", F.lit(1).cast("long").alias("_one"), turn.alias("_turn"), "_value")
    ends = F.explode(F.array(F.struct(F.col("lo").alias("_at"), F.lit(0).alias("_rank")), F.struct(F.col("hi").alias("_at"), F.lit(2).alias("_rank")))).alias("_e")
    marks = intervals.select(*keys, who.alias("_who"), ends).select(
        *keys, "_e._at", "_e._rank", none.alias("_tie"), zero.alias("_one"), zero.alias("_turn"), F.lit(None).cast(kinds["_value"].dataType).alias("_value"), "_who"
    )
    both = rows.withColumn("_who", F.lit(None).cast(marks.schema["_who"].dataType)).unionByName(marks)
    point = F.when(F.col("_rank") == 1, F.struct("_value", "_turn"))
    run = o.scan(both, keys, ["_at", "_rank", "_tie", "_who"], o.time_block("_at", block_ms), {"_n": o.run_sum("_one"), "_c": o.run_sum("_turn"), "_first": o.after(point)})
    start, end = F.col("_rank") == 0, F.col("_rank") == 2
    out = run.filter("_rank <> 1").groupBy(*keys, "_who").agg(
        (F.max(F.when(end, F.col("_n"))) - F.max(F.when(start, F.col("_n")))).alias("n"), (F.max(F.when(end, F.col("_c"))) - F.max(F.when(start, F.col("_c")))).alias("_turns"),
        F.max(F.when(start, F.col("_first"))).alias("_first"),
    )
    inside = F.col("n") > 0
    return out.select(
        *keys, *[F.col(f"_who.{n}").alias(n) for n in names], F.col("_who._lo").alias("lo"), "n",
        F.when(inside, F.col("_first._value")).alias("first"), F.when(inside, F.col("_turns") == F.col("_first._turn")).alias("same"),
    )


def within_left(left, right, keys, t, tolerance: int, tie: str, right_prefix: str = "r_") -> DataFrame:
    """As ``within`` but keeps left rows without a partner (right columns null)."""
    pairs = within(left, right, keys, t, tolerance, right_prefix)
    added = [c for c in pairs.columns if c not in left.columns]
    lonely = left.join(pairs.select(*keys, tie).distinct(), [*keys, tie], "left_anti")
    return pairs.unionByName(
        lonely.withColumns({c: F.lit(None).cast(pairs.schema[c].dataType) for c in added})
    )


def overlaps(left, right, keys, left_span, right_span, bucket_ms: int, ids: Sequence[str]) -> DataFrame:
    """Half-open interval overlap by exploding both sides to buckets.

    A pair meets in several buckets; it is kept only in the bucket where the later of the
    two starts lies, so no distinct is needed.
    """
    (l0, l1), (r0, r1) = left_span, right_span
    keys = list(keys)

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        first = F.floor(F.col(start) / bucket_ms).cast("long")
        last = F.floor((F.col(end) - 1) / bucket_ms).cast("long")
        return df.filter(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(first, last)))

    pairs = spread(left, l0, l1).join(spread(right, r0, r1), [*keys, "_b"])
    home = F.floor(F.greatest(F.col(l0), F.col(r0)) / bucket_ms).cast("long")
    return pairs.filter((F.col(l1) > F.col(r0)) & (F.col(r1) > F.col(l0)) & (F.col("_b") == home)).drop("_b")


def bucket(t, size: int, base: int = 0) -> Column:
    """Fixed window index: base + floor(t/size)."""
    return (F.floor(F.col(t) / size) + base).cast("long")
