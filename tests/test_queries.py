"""Every registered query is well formed; a spread of them meets its reference SQL."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import close, rows_of

SAMPLE = [
    "flagship_stream_validation", "C5_nearest_asof", "C9_interval_overlap", "C16_add_before_removal", "C30_candidate_sets", "D6_quantiles",
    "D14_scalar_match_score", "D46_leave_one_match_out", "E9_slot_clusters_gap2", "E11_probe_samples", "I1_kill_assembly", "I8_multiset_fold",
    "J1_byte_field_sweep", "J28_greedy_assignment", "K7_schema_drift", "A2_framed_ingestion", "S1_interval_counts", "H13_fnv1a64",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, duck, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(oracle_sql()[name])
    ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == ocols and len(got) == len(want)
    assert all(close(a, b) for r, w in zip(got, want) for a, b in zip(r, w))


def test_partition_count_does_not_matter(spark, sf_dir):
    name = "flagship_stream_validation"
    first = sorted(map(str, queries()[name](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, queries()[name](spark, sf_dir).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scores_are_rounded_once(spark, sf_dir):
    """Nine digits first and six afterwards would move some sixth digits (J51, J52)."""
    from eventloom.plans.assignments import best_transform, supplement_patterns
    from eventloom.plans.standins import Tables

    for fn, name in ((best_transform, "score"), (supplement_patterns, "confidence")):
        scores = [r[0] for r in fn(Tables(spark, sf_dir)).select(name).collect()]
        assert any(v != round(v, 9) for v in scores)
