"""Ordered scans that survive a hot key.

``Window.partitionBy(key)`` sends a whole key to one task. ``scan`` instead windows
inside (key, block), where ``block`` is a monotone function of the order (usually a
time bucket), reduces every block to one carry row, runs the window over carry rows
only, and joins the carry back. The join has the same (key, block) clustering as the
window, so the rows shuffle once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.stats import col

BLOCK = "_block"
#: Rows that a task has on average where ``task_count`` deals them.
TASK_ROWS = 500_000


def task_count(df: DataFrame) -> int:
    """Tasks for ``repartition`` over which a task's share does not grow with ``df``, whose rows are counted.

    For groupings of almost as many groups as rows, whose tables in memory would grow with them.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def time_block(t, size: int) -> Column:
    return F.floor(col(t) / F.lit(size)).cast("long")


class Spec:
    """One output of a scan: ``kind`` over ``expr``."""

    def __init__(self, kind: str, expr):
        self.kind, self.expr = kind, col(expr)


def run_sum(expr):
    return Spec("sum", expr)


def run_count(expr=None):
    return Spec("sum", F.when(expr, 1).otherwise(0).cast("long") if expr is not None else F.lit(1).cast("long"))


def run_min(expr):
    return Spec("min", expr)


def run_max(expr):
    return Spec("max", expr)


def max_before(expr):
    """Largest value strictly before this row."""
    return Spec("max_before", expr)


def last_seen(expr):
    """Latest non-null value up to and including this row."""
    return Spec("last", expr)


def before(expr):
    """Latest non-null value strictly before this row."""
    return Spec("before", expr)


def next_seen(expr):
    """Earliest non-null value from this row on."""
    return Spec("next", expr)


def after(expr):
    """Earliest non-null value strictly after this row."""
    return Spec("after", expr)


def prev(expr):
    return Spec("prev", expr)


def following(expr):
    return Spec("following", expr)


FORWARD = {"sum", "min", "max", "max_before", "last", "before", "prev"}


def _local(spec: Spec, up, down) -> Column:
    whole, strict = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    if spec.kind in ("sum", "min", "max"):
        return getattr(F, spec.kind)(spec.expr).over(up.rowsBetween(*whole))
    if spec.kind == "max_before":
        return F.max(spec.expr).over(up.rowsBetween(*strict))
    if spec.kind in ("last", "before"):
        return F.last(spec.expr, ignorenulls=True).over(up.rowsBetween(*(whole if spec.kind == "last" else strict)))
    if spec.kind in ("next", "after"):
        return F.last(spec.expr, ignorenulls=True).over(down.rowsBetween(*(whole if spec.kind == "next" else strict)))
    # prev/following keep null payloads, so carry presence in a one-field struct
    boxed = F.struct(spec.expr.alias("v"))
    return F.lag(boxed, 1).over(up) if spec.kind == "prev" else F.lead(boxed, 1).over(up)


def _summary(spec: Spec, order: Column) -> Column:
    if spec.kind == "max_before":
        return F.max(spec.expr)
    if spec.kind in ("sum", "min", "max"):
        return getattr(F, spec.kind)(spec.expr)
    seen = F.when(spec.expr.isNotNull(), order)
    if spec.kind in ("last", "before"):
        return F.max_by(spec.expr, seen)
    if spec.kind in ("next", "after"):
        return F.min_by(spec.expr, seen)
    boxed = F.struct(spec.expr.alias("v"))
    return F.max_by(boxed, order) if spec.kind == "prev" else F.min_by(boxed, order)


def _carry(spec: Spec, name: str, up, down) -> Column:
    window = (up if spec.kind in FORWARD else down).rowsBetween(Window.unboundedPreceding, -1)
    if spec.kind == "max_before":
        return F.max(name).over(window)
    if spec.kind in ("sum", "min", "max"):
        return getattr(F, spec.kind)(name).over(window)
    return F.last(name, ignorenulls=True).over(window)


def _combine(spec: Spec, local: Column, carry: Column) -> Column:
    if spec.kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(local + carry)
    if spec.kind == "min":
        return F.least(local, carry)
    if spec.kind in ("max", "max_before"):
        return F.greatest(local, carry)
    value = F.coalesce(local, carry)
    return value["v"] if spec.kind in ("prev", "following") else value


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    outputs: Mapping[str, Spec],
) -> DataFrame:
    """Add one column per output, computed along ``order`` within ``keys``.

    ``order`` must be unique within a key. ``block`` must not fall as the order rises;
    ``None`` means the keys are known to be small and a plain window is used.
    """
    keys, order = list(keys), list(order)
    if block is None:
        up = Window.partitionBy(*keys).orderBy(*order)
        down = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
        cols = {n: _local(s, up, down) for n, s in outputs.items()}
        return df.withColumns(
            {n: c["v"] if outputs[n].kind in ("prev", "following") else c for n, c in cols.items()}
        )
    df = df.withColumn(BLOCK, block)
    up = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    down = Window.partitionBy(*keys, BLOCK).orderBy(*[F.desc(o) for o in order])
    rank = F.struct(*[F.col(o) for o in order])
    local = df.withColumns({f"_l_{n}": _local(s, up, down) for n, s in outputs.items()})
    carry = df.groupBy(*keys, BLOCK).agg(*[_summary(s, rank).alias(f"_c_{n}") for n, s in outputs.items()])
    cup = Window.partitionBy(*keys).orderBy(BLOCK)
    cdown = Window.partitionBy(*keys).orderBy(F.desc(BLOCK))
    carry = carry.select(
        *keys, BLOCK, *[_carry(s, f"_c_{n}", cup, cdown).alias(f"_k_{n}") for n, s in outputs.items()]
    )
    joined = local.join(carry, [*keys, BLOCK], "left")
    base = [c for c in df.columns if c != BLOCK]
    return joined.select(
        *base, *[_combine(s, F.col(f"_l_{n}"), F.col(f"_k_{n}")).alias(n) for n, s in outputs.items()]
    )


def position(df, keys, order, block, name="rn") -> DataFrame:
    """One-based position along the order."""
    return scan(df, keys, order, block, {name: run_count()})


def islands(df, keys, order, block, starts: Column, name="island", before_row: Mapping[str, Column | str] | None = None) -> DataFrame:
    """Number runs along the order, 1-based per key; ``starts`` marks the first row of a run.

    ``before_row`` names values of the previous row that ``starts`` refers to (null on the first
    row of a key). One pass: inside a block only its first row needs the block before, so that
    row's flag and the counts of earlier blocks are settled on the carry rows.
    """
    keys, order, before_row = list(keys), list(order), dict(before_row or {})
    base = list(df.columns)
    payload = F.struct(*[col(v).alias(n) for n, v in before_row.items()], F.lit(1).alias("_x"))
    flag = F.when(starts, 1).otherwise(0).cast("long")
    df = df.withColumn(BLOCK, block if block is not None else F.lit(0).cast("long"))
    up = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    local = df.withColumn("_lag", F.lag(payload, 1).over(up))
    local = local.withColumns({n: F.col(f"_lag.{n}") for n in before_row})
    head = F.col("_lag").isNull()
    if block is None:
        out = local.withColumn("_f", flag).withColumn(name, F.sum("_f").over(up.rowsBetween(Window.unboundedPreceding, 0)))
        return out.select(*base, name)
    local = local.withColumn("_f", F.when(head, F.lit(0).cast("long")).otherwise(flag))
    spot = F.struct(*[F.col(o_) for o_ in order])
    carry = local.groupBy(*keys, BLOCK).agg(
        F.min_by(F.struct(*[F.col(c) for c in base if c not in keys]), spot).alias("_head"), F.max_by(payload, spot).alias("_tail"), F.sum("_f").alias("_inner")
    )
    cup = Window.partitionBy(*keys).orderBy(BLOCK)
    carry = carry.withColumn("_lag", F.lag("_tail", 1).over(cup))
    carry = carry.select(*keys, BLOCK, "_inner", "_head.*", *[F.col(f"_lag.{n}").alias(n) for n in before_row])
    carry = carry.withColumn("_first", flag)
    carry = carry.withColumn("_upto", F.sum(F.col("_inner") + F.col("_first")).over(cup.rowsBetween(Window.unboundedPreceding, 0)))
    carry = carry.select(*keys, BLOCK, (F.col("_upto") - F.col("_inner")).alias("_base"))
    local = local.withColumn("_run", F.sum("_f").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    out = local.join(carry, [*keys, BLOCK])
    return out.select(*base, (F.col("_base") + F.col("_run")).alias(name))


def gap_islands(df, keys, t: str, order, block, max_gap, name="island") -> DataFrame:
    """Runs whose consecutive ``t`` differ by at most ``max_gap``; 1-based per key."""
    prior = F.col("_prior")
    return islands(df, keys, order, block, prior.isNull() | (F.col(t) - prior > max_gap), name, {"_prior": t})


def floored_sum(df, keys, order, block, delta: str, count: str, before: str) -> DataFrame:
    """Running sum that never falls below zero, after and before each row, in one pass.

    With S the plain running sum the floored one is S - min(0, running min of S); both merge
    over blocks from a block's total and the lowest prefix inside it.
    """
    keys, order, base = list(keys), list(order), list(df.columns)
    df = df.withColumn(BLOCK, block if block is not None else F.lit(0).cast("long"))
    up = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    upto, strict = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    local = df.withColumn("_s", F.sum(delta).over(up.rowsBetween(*upto)))
    carry = local.groupBy(*keys, BLOCK).agg(F.sum(delta).alias("_d"), F.min("_s").alias("_low"))
    cup = Window.partitionBy(*keys).orderBy(BLOCK)
    carry = carry.withColumn("_sum", F.coalesce(F.sum("_d").over(cup.rowsBetween(*strict)), F.lit(0)))
    carry = carry.withColumn("_min", F.coalesce(F.min(F.col("_sum") + F.col("_low")).over(cup.rowsBetween(*strict)), F.lit(0)))
    local = local.withColumns({"_m": F.min("_s").over(up.rowsBetween(*upto)), "_mb": F.min("_s").over(up.rowsBetween(*strict))})
    out = local.join(carry.select(*keys, BLOCK, "_sum", "_min"), [*keys, BLOCK])
    total = F.col("_sum") + F.col("_s")
    low = F.least(F.lit(0), F.col("_min"), F.col("_sum") + F.col("_m"))
    low_before = F.least(F.lit(0), F.col("_min"), F.col("_sum") + F.col("_mb"))
    return out.select(*base, (total - low).alias(count), (total - F.col(delta) - low_before).alias(before))


def top_k(df, keys, order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Spark trims each partition to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def best(df, keys, order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)
