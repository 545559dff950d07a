"""Packet and event selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import ordered as o


def window_filter(df: DataFrame, t: str, start: int, end: int, *extra: Column) -> DataFrame:
    """Inclusive time window plus optional predicates; all reach the scan as one filter."""
    if start > end:
        raise ValueError("window start lies after its end")
    out = df.filter(F.col(t).between(start, end))
    for cond in extra:
        out = out.filter(cond)
    return out


def length_allowed(length, exact: Column, low: Column, high: Column) -> Column:
    """An exact list, or else an inclusive range."""
    return F.array_contains(exact, F.col(length).cast("int")) | F.col(length).between(low, high)


def important(df: DataFrame, keys, wanted: Column, fallback: Column, order, limit: int) -> DataFrame:
    """Wanted rows per key, or the fallback rows where a key has none; first ``limit`` in order."""
    has = df.groupBy(*keys).agg(F.bool_or(wanted).alias("_has"))
    out = df.join(has, list(keys)).filter(F.when(F.col("_has"), wanted).otherwise(fallback)).drop("_has")
    return o.top_k(out, keys, [F.asc(c) for c in order], limit)
