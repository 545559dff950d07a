"""Quality gates: rule tables, counts, breakdowns, ordering, drift and taxonomies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators import ordered as o


def contract(df: DataFrame, rules: Mapping[str, Column], ident: Sequence[str]) -> DataFrame:
    """One row per violated rule; a null outcome counts as a violation."""
    fired = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull()
    )
    return df.select(*ident, F.explode(fired).alias("violation"))


def contract_summary(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """Violation count per rule and an overall pass flag."""
    bad = {n: F.count_if(~F.coalesce(ok, F.lit(False))) for n, ok in rules.items()}
    total = None
    for c in bad.values():
        total = c if total is None else total + c
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in bad.items()], (total == 0).alias("passes"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def expected_counts(actual: DataFrame, expected: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Null-safe comparison of counts with an expectation table; missing partitions fail."""
    e = expected.select(*keys, *[F.col(f).alias(f"expected_{f}") for f in fields])
    out = actual.join(e, list(keys), "full")
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.col(f).eqNullSafe(F.col(f"expected_{f}"))
    return out.withColumn("passes", ok)


def breakdown(parents: DataFrame, parts: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """Nested totals against their parent."""
    got = parts.groupBy(*keys).agg(F.sum(total).alias("part_total"))
    out = parents.join(got, list(keys), "full")
    return out.withColumn("consistent", F.col(total).eqNullSafe(F.col("part_total")))


def ordering(df: DataFrame, keys: Sequence[str], rank: str, score: str, block=None) -> DataFrame:
    """Published ranking sanity: ranks contiguous from 1, score never rising."""
    out = o.scan(df, keys, [rank], block, {"_ps": o.prev(score), "_pr": o.prev(rank)})
    return out.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(F.col(score) > F.col("_ps")).alias("rises"),
        F.count_if(F.col(rank) != F.coalesce(F.col("_pr"), F.lit(0)) + 1).alias("gaps"),
    )


def drift(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """added / removed / changed / same rows between two runs, with the changed fields."""
    a = before.select(*keys, F.lit(True).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = after.select(*keys, F.lit(True).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    moved = F.filter(
        F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]), lambda v: v.isNotNull()
    )
    out = a.join(b, list(keys), "full")
    status = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(moved) > 0, "changed").otherwise("same")
    )
    return out.select(*keys, status.alias("status"), F.when(status == "changed", F.array_join(moved, ",")).alias("fields"))


def reconcile(sets: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Ids that are missing from one of several sets or repeated inside one."""
    out = None
    for i, (name, df) in enumerate(sets.items()):
        part = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    per = out.groupBy(key).agg(*[F.sum(F.when(F.col("set") == n, F.col("n")).otherwise(0)).alias(n) for n in sets])
    missing = F.filter(F.array(*[F.when(F.col(n) == 0, F.lit(f"missing-{n}")).when(F.col(n) > 1, F.lit(f"duplicate-{n}")) for n in sets]), lambda v: v.isNotNull())
    return per.select(key, F.explode(missing).alias("violation"))
