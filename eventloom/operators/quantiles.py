"""Exact order statistics that never hold a large group in one task.

Keys of at most ``ONE_BLOCK`` rows are sorted as they are. A key with more rows is bracketed: two
approximate percentiles enclose the wanted index, rows below them are only counted, and the few rows
between them give the exact value. Ranks of all rows cut such a key into blocks. Brackets and cuts are
approximate, so they are computed once and checkpointed: another evaluation may give others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import ordered as o
from eventloom.session import cut_lineage

BUCKETS = 128
#: Rows, or distinct values, of a key that one block takes.
ONE_BLOCK = 1 << 16
#: A bracket reaches this share of a key's rows to either side of the wanted index.
REACH = 1 / 128


def usable(value: str) -> Column:
    """``value`` as a double, null where it is not a number."""
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, cum, total): distinct values with their cumulative count."""
    keys = list(keys)
    counts = df.withColumn(value, usable(value)).filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    wide = counts.groupBy(*keys).agg(F.count("*").alias("_distinct"), F.percentile_approx(value, shares, 4 * BUCKETS).alias("_cuts"))
    # only a key too wide for one block is cut; such keys are few
    wide = cut_lineage(wide.filter(F.col("_distinct") > ONE_BLOCK).drop("_distinct"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    if keys:
        counts = counts.join(totals, keys).join(F.broadcast(wide), keys, "left")
    else:
        counts = counts.crossJoin(F.broadcast(totals)).join(F.broadcast(wide), F.lit(True), "left")
    part = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))).cast("long")
    counts = counts.withColumn("_part", part).drop("_cuts")
    return o.scan(counts, keys, [value], F.col("_part"), {"cum": o.run_sum("n")}).drop("_part")


def _index(p: float, n: str, floor_index: bool) -> Column:
    if floor_index:
        return F.least(F.col(n) - 1, F.floor(F.lit(float(p)) * F.col(n))).cast("double")
    return F.lit(float(p)) * (F.col(n) - 1)


def _between(below: Column, above: Column, at: Column) -> Column:
    return below + (above - below) * (at - F.floor(at))


def _small(df: DataFrame, keys, count: int, probs: Mapping[str, float], floor_index: bool) -> DataFrame:
    """Quantiles of ``_v0``, ``_v1``, ... for keys that one task can sort."""
    aggs = []
    for i in range(count):
        v, rank, n = f"_v{i}", f"_r{i}", f"_n{i}"
        up = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(v))
        whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        df = df.withColumns({rank: F.row_number().over(up), n: F.count(v).over(whole)})
        for name, p in probs.items():
            at = _index(p, n, floor_index)
            below, above = (F.max(F.when(F.col(rank) == f(at) + 1, F.col(v))) for f in (F.floor, F.ceil))
            aggs.append(_between(below, above, F.max(at)).alias(f"{name}_{i}"))
    return df.groupBy(*keys).agg(*aggs)


def _crowded(df: DataFrame, keys, count: int, probs: Mapping[str, float], floor_index: bool) -> DataFrame:
    """The same for few keys of very many rows."""
    cells = F.array(*[F.struct(F.lit(i).alias("_name"), F.col(f"_v{i}").alias("_value")) for i in range(count)])
    cells = df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*").filter(F.col("_value").isNotNull())
    cell, names = [*keys, "_name"], list(probs)
    shares = [min(1.0, max(0.0, probs[n] + side * REACH)) for n in names for side in (-1, 1)]
    spans = cells.groupBy(*cell).agg(F.count("*").alias("_n"), F.percentile_approx("_value", shares, int(16 / REACH)).alias("_ends"))
    spans = F.broadcast(cut_lineage(spans))
    # a column with few values in such a key is taken whole
    few = F.col("_n") * REACH < 8
    low, high = (F.when(few, F.lit(float(f"{sign}inf"))) for sign in "-+")
    ends = [(low.otherwise(F.col("_ends")[2 * j]), high.otherwise(F.col("_ends")[2 * j + 1])) for j in range(len(names))]
    marked = cells.join(spans, cell)
    below = marked.groupBy(*cell, "_n").agg(F.array(*[F.count_if(F.col("_value") < low) for low, _ in ends]).alias("_b"))
    below = below.select(*cell, "_n", F.posexplode("_b").alias("_j", "_before"))
    hits = F.array_compact(F.array(*[F.when(F.col("_value").between(*end), F.lit(j)) for j, end in enumerate(ends)]))
    inside = marked.select(*cell, "_value", F.explode(hits).alias("_j")).groupBy(*cell, "_j", "_value").agg(F.count("*").alias("_m"))
    cum = F.sum("_m").over(Window.partitionBy(*cell, "_j").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("_cum", cum).join(F.broadcast(below), [*cell, "_j"]).withColumn("_cum", F.col("_cum") + F.col("_before"))
    at = F.lit(None).cast("double")
    for j, name in enumerate(names):
        at = F.when(F.col("_j") == j, _index(probs[name], "_n", floor_index)).otherwise(at)
    inside = inside.withColumn("_at", at)
    low, high = (F.min(F.when(F.col("_cum") > f("_at"), F.col("_value"))) for f in (F.floor, F.ceil))
    found = (F.max("_before") <= F.floor(F.max("_at"))) & high.isNotNull()
    value = F.when(found, _between(low, high, F.max("_at"))).otherwise(F.raise_error(F.lit("a bracket misses its quantile")).cast("double"))
    out = inside.groupBy(*cell, "_j").agg(value.alias("_q"))
    pick = [(i, j) for i in range(count) for j in range(len(names))]
    return out.groupBy(*keys).agg(
        *[F.max(F.when((F.col("_name") == i) & (F.col("_j") == j), F.col("_q"))).alias(f"{names[j]}_{i}") for i, j in pick]
    )


def _order_statistics(df: DataFrame, keys, cols: Sequence[str], probs: Mapping[str, float], floor_index: bool = False) -> DataFrame:
    """``<name>_<i>`` per key for every probability and the i-th column; null without values."""
    keys = list(keys)
    df = df.select(*keys, *[usable(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    by = keys or ["_all"]
    if not keys:
        df = df.withColumn("_all", F.lit(0))
    hot = cut_lineage(df.groupBy(*by).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > ONE_BLOCK).select(*by))
    if hot.isEmpty():
        out = _small(df, by, len(cols), probs, floor_index)
    else:
        small = _small(df.join(F.broadcast(hot), by, "left_anti"), by, len(cols), probs, floor_index)
        out = small.unionByName(_crowded(df.join(F.broadcast(hot), by, "left_semi"), by, len(cols), probs, floor_index))
    return out if keys else out.drop("_all")


def quantiles(df: DataFrame, keys, value: str, probs: Mapping[str, float], floor_index: bool = False) -> DataFrame:
    """One row per key with a column per probability.

    Linear interpolation between neighbours, or the value at index min(n-1, floor(p*n)).
    """
    out = _order_statistics(df, keys, [value], probs, floor_index)
    return out.select(*keys, *[F.col(f"{name}_0").alias(name) for name in probs]).dropna(subset=list(probs))


def median_mad(df: DataFrame, keys, value: str) -> DataFrame:
    """Median and median absolute deviation, 0 on empty groups."""
    keys = list(keys)
    med = cut_lineage(quantiles(df, keys, value, {"median": 0.5}))
    away = df.join(med, keys).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    mad = quantiles(away, keys, "_away", {"mad": 0.5})
    return med.join(mad, keys)


def mode(df: DataFrame, keys, value: str, name: str = "mode") -> DataFrame:
    """Most frequent value; ties go to the first in string order."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    pick = F.min_by(value, F.struct(-F.col("n"), F.col(value).cast("string")))
    return counts.groupBy(*keys).agg(pick.alias(name), F.max("n").alias(f"{name}_count"))


def average_ranks(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """Rows with the average rank of their value within the key."""
    placed = value_positions(df, keys, value)
    ranks = placed.select(
        *keys, F.col(value).alias("_v"), (F.col("cum") - F.col("n") + (F.col("n") + 1) / 2).alias(name)
    )
    hit = df.withColumn("_v", F.col(value).cast("double"))
    return hit.join(ranks, [*keys, "_v"]).drop("_v")


def medians(df: DataFrame, keys, cols: Sequence[str], suffix: str = "_median") -> DataFrame:
    """Exact medians of several columns; 0 where a key has no value of a column."""
    med = _order_statistics(df, keys, cols, {"m": 0.5})
    return med.select(*keys, *[F.coalesce(f"m_{i}", F.lit(0.0)).alias(c + suffix) for i, c in enumerate(cols)])
