"""Blocked scans equal plain windows, whatever the block size, partitioning or skew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import ordered as o
from eventloom.operators import quantiles as q


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    # one key holds most rows; times repeat; values have gaps
    keys = np.where(rng.random(600) < 0.6, 1, rng.integers(2, 8, 600))
    data = [(int(k), int(t), i, None if rng.random() < 0.3 else float(v)) for i, (k, t, v) in enumerate(zip(keys, rng.integers(0, 300, 600), rng.normal(size=600)))]
    return spark.createDataFrame(data, "k int, t long, id long, v double")


OUT = {
    "s": lambda: o.run_sum("v"), "c": lambda: o.run_count(F.col("v") > 0), "lo": lambda: o.run_min("v"), "hi": lambda: o.run_max("v"), "hb": lambda: o.max_before("v"),
    "last": lambda: o.last_seen("v"), "before": lambda: o.before("v"), "next": lambda: o.next_seen("v"), "after": lambda: o.after("v"),
    "prev": lambda: o.prev("v"), "following": lambda: o.following("v"),
}


def collect(df):
    return sorted(tuple(None if x is None else round(x, 9) for x in r) for r in df.select("id", *OUT).collect())


@pytest.mark.parametrize("block", [1, 7, 50, 10_000])
def test_scan_matches_plain_window(rows, block):
    plain = collect(o.scan(rows, ["k"], ["t", "id"], None, {n: f() for n, f in OUT.items()}))
    blocked = o.scan(rows.repartition(3), ["k"], ["t", "id"], o.time_block("t", block), {n: f() for n, f in OUT.items()})
    assert collect(blocked) == plain


def test_gap_islands(rows):
    got = o.gap_islands(rows, ["k"], "t", ["t", "id"], o.time_block("t", 20), 2).collect()
    by_key = {}
    for r in sorted(got, key=lambda r: (r.k, r.t, r.id)):
        by_key.setdefault(r.k, []).append((r.t, r.island))
    for series in by_key.values():
        island, prior = 0, None
        for t, got_island in series:
            if prior is None or t - prior > 2:
                island += 1
            prior = t
            assert got_island == island


@pytest.mark.parametrize("one_block", [1 << 16, 8])
def test_quantiles_match_numpy(rows, one_block, monkeypatch):
    monkeypatch.setattr(q, "ONE_BLOCK", one_block)  # the narrow one cuts every key into blocks
    got = {r.k: r for r in q.quantiles(rows, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.93}).collect()}
    flo = {r.k: r for r in q.quantiles(rows, ["k"], "v", {"f": 0.95}, floor_index=True).collect()}
    values = {}
    for r in rows.filter("v IS NOT NULL").collect():
        values.setdefault(r.k, []).append(r.v)
    for k, v in values.items():
        assert got[k].m == pytest.approx(np.quantile(v, 0.5))
        assert got[k].a == pytest.approx(np.quantile(v, 0.1)) and got[k].z == pytest.approx(np.quantile(v, 0.93))
        assert flo[k].f == sorted(v)[min(len(v) - 1, int(0.95 * len(v)))]


def test_quantiles_of_a_wide_key_do_not_depend_on_the_evaluation(spark):
    """Two evaluations of approximate cuts differ; exact answers must not."""
    values = np.random.default_rng(5).lognormal(3, 2, 200_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(24).withColumn("k", F.lit("a"))
    probs = {"a": 0.1, "m": 0.5, "z": 0.93}
    for keys in (["k"], []):
        got = q.quantiles(df, keys, "v", probs).first()
        assert [got[n] for n in probs] == pytest.approx([np.quantile(values, p) for p in probs.values()], rel=1e-12)
    placed = q.value_positions(df, ["k"], "v").filter("cum % 25000 = 0").collect()
    order = np.sort(values)
    assert len(placed) == 8 and all(order[r.cum - 1] == r.v for r in placed)


@pytest.mark.parametrize("one_block", [1 << 16, 2])
def test_medians_of_columns_with_nulls(spark, one_block, monkeypatch):
    monkeypatch.setattr(q, "ONE_BLOCK", one_block)
    df = spark.createDataFrame([(1, 5.0, None), (1, 2.0, None), (1, 9.0, None), (2, float("nan"), 4.0), (2, 1.0, 7.0)], "k int, a double, b double")
    assert {tuple(r) for r in q.medians(df, ["k"], ["a", "b"]).collect()} == {(1, 5.0, 0.0), (2, 1.0, 5.5)}


def test_mode_breaks_ties_by_text(spark):
    df = spark.createDataFrame([(1, 9), (1, 10), (2, 3), (2, 3), (2, 1)], "k int, v int")
    assert {r.k: r.mode for r in q.mode(df, ["k"], "v").collect()} == {1: 10, 2: 3}


def test_order_agreement_counts_every_pair(spark):
    from eventloom.operators import series as sr

    rng = np.random.default_rng(4)
    data = [(int(k), int(s), int(v)) for k, s, v in zip(rng.integers(1, 3, 150), rng.integers(0, 30, 150), rng.integers(-9, 40, 150))]
    df = spark.createDataFrame([*data, (1, None, 3), (1, 3, None)], "k int, slot long, v long")
    for keys in (["k"], []):
        got = {tuple(r[c] for c in keys): (r.comparable, r.ordered) for r in sr.order_agreement(df, keys, "slot", "v", block=7).collect()}
        want: dict = {}
        for a in data:
            for b in data:
                if a[1] < b[1] and a[2] != b[2] and (not keys or a[0] == b[0]):
                    c, o_ = want.get((a[0],) if keys else (), (0, 0))
                    want[(a[0],) if keys else ()] = (c + 1, o_ + (a[2] < b[2]))
        assert got == want


def test_slot_clusters_have_more_tasks_for_more_rows(spark, monkeypatch):
    from eventloom.operators import sequences as sq

    monkeypatch.setattr(o, "TASK_ROWS", 50, raising=False)
    df = spark.range(1000).select((F.col("id") % 250).alias("g"), F.floor(F.col("id") / 250).alias("slot"), F.lit(2).alias("w"))
    got = sq.slot_clusters(df, ["g"], "slot", 1, "w").withColumn("task", F.spark_partition_id()).collect()
    assert {(r.g, r.cluster, r.first_slot, r.last_slot, r.slots, r.entries, r.weight) for r in got} == {(g, 1, 0, 3, 4, 4, 8) for g in range(250)}
    assert len({r.task for r in got}) > 10
