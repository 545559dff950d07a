"""Framing golden cases, profiles, artifacts and streams."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from eventloom.functions import binary as bn
from eventloom.functions import labels as lb
from eventloom.functions import stats as s
from eventloom.operators.packets import window_filter
from eventloom.sources import artifacts as ar
from eventloom.sources import bundles as bd
from eventloom.sources import framing as fr


def rows(data):
    return [dict(zip(fr.NAMES, r)) for r in fr.parse_segment(data)]


FULL = b"\x03" + struct.pack("<fIHI", 12.5, 2, 0x1234, 0x400000B4) + b"ab"


def test_direct_then_compact_block():
    compact = b"\xf3" + bytes([25, 1]) + struct.pack("<b", -5) + b"z"
    got = rows(FULL + compact)
    assert [r["is_error"] for r in got] == [False, False]
    assert got[0]["ts_seconds"] == 12.5 and got[0]["channel"] == 3 and got[0]["payload"] == b"ab"
    assert got[1]["ts_seconds"] == pytest.approx(12.525) and got[1]["packet_type"] == 0x1234
    assert got[1]["block_param"] == 0x400000AF and got[1]["end_offset"] == len(FULL + compact)


def test_param_wraps_around():
    first = b"\x00" + struct.pack("<fIHI", 1.0, 0, 7, 2)
    second = b"\x60" + struct.pack("<fI", 1.0, 0) + struct.pack("<b", -5)
    assert rows(first + second)[1]["block_param"] == 0xFFFFFFFD


@pytest.mark.parametrize(
    "data,code,at",
    [
        (b"\x00\x00", "truncated-time", 1), (b"\x80\x00", "truncated-length", 2), (b"\x90\x00\x01", "truncated-type", 3),
        (b"\xd0\x00\x01", "missing-inherited-type", 3), (b"\x00" + struct.pack("<f", math.nan), "non-finite-time", 1),
    ],
)
def test_error_codes(data, code, at):
    (row,) = rows(data)
    assert row["is_error"] and row["code"] == code and row["error_offset"] == at


def test_valid_block_survives_a_truncated_one(spark):
    df = spark.createDataFrame([(1, FULL + FULL[:-1]), (2, FULL)], "seg int, content binary")
    parsed = fr.parse_packets(df, ["seg"], "content")
    assert sorted((r.seg, r.block_index) for r in fr.packets(parsed).collect()) == [(1, 0), (2, 0)]
    (err,) = fr.packet_errors(parsed, ["seg"]).collect()
    assert (err.seg, err.block_index, err.code, err.declared_content_length) == (1, 1, "truncated-payload", 2)


def test_segments_from_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(FULL)
    parsed = fr.parse_packets(fr.read_segments(spark, str(tmp_path)), ["path"], "content")
    assert parsed.count() == 1


def test_artifact_round_trip_and_incremental(spark, tmp_path):
    path = str(tmp_path / "art")
    df = spark.range(100).select("id", (F.col("id") % 4).alias("p"))
    manifest = ar.write_artifact(df, path, ["p"])
    saved = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert ar.stale_partitions(ar.fingerprint(df, ["p"]), saved, ["p"]).count() == 0
    changed = df.withColumn("id", F.when(F.col("p") == 2, F.col("id") + 1000).otherwise(F.col("id")))
    stale = ar.stale_partitions(ar.fingerprint(changed, ["p"]), saved, ["p"])
    assert [r.p for r in stale.collect()] == [2]
    ar.write_artifact(changed, path, ["p"], stale)
    back = ar.read_artifact(spark, path)
    assert back.count() == 100 and back.filter("id >= 1000").count() == 25


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).select("id", F.lit(1).alias("p"))
    a = ar.fingerprint(df, ["p"]).first()
    b = ar.fingerprint(df.orderBy(F.desc("id")).repartition(7), ["p"]).first()
    assert a == b


def test_profiles_fail_closed(spark):
    docs = ['{"group":"16.1","accepted":["16.1.4"],"lengths":[4],"offset":8}', '{"group":"16.2","accepted":["15.9.1"],"lengths":[4],"offset":8}']
    good, bad = bd.validate_profiles(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc")
    assert [r.group for r in good.collect()] == ["16.1"]
    assert [r.violation for r in bad.collect()] == ["version-outside-group"]
    out = bd.with_profile(spark.createDataFrame([("16.1",), ("16.2",)], "vg string"), good, "vg").collect()
    assert {r.vg: r.supported for r in out} == {"16.1": True, "16.2": False}


def test_window_start_after_end(spark):
    with pytest.raises(ValueError):
        window_filter(spark.range(3), "id", 5, 1)


@pytest.mark.parametrize("value", [0.0, -1.5, 3.25e20, 1e-40, float("inf"), -float("inf")])
def test_float32_bits(spark, value):
    raw = struct.unpack("<I", struct.pack("<f", value))[0]
    want = struct.unpack("<f", struct.pack("<f", value))[0]
    assert spark.range(1).select(bn.float32_from_bits(F.lit(raw)).alias("f")).first().f == pytest.approx(want)


def test_fnv1a64(spark):
    assert spark.createDataFrame([("a",)], "s string").select(lb.fnv1a64("s").alias("h")).first().h == "af63dc4c8601ec8c"


def test_statistics_conventions(spark):
    flat = spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")
    r = flat.agg(s.pearson_zero("x", "y").alias("z"), s.pearson_null("x", "y").alias("n"), s.affine("x", "y").alias("f")).first()
    assert r.z == 0 and r.n is None and not r.f.valid and r.f.slope == 0 and r.f.intercept == 2.0
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    r = two.agg(s.pearson_zero("x", "y").alias("z"), s.pearson_null("x", "y").alias("n"), s.affine("x", "y").alias("f")).first()
    assert r.z == 0 and r.n == pytest.approx(1) and r.f.rmse == float("inf")
    assert two.select(s.js_round(F.lit(-2.5)).alias("v")).first().v == -2


def test_large_means_keep_precision(spark):
    df = spark.range(1000).select((F.col("id") + F.lit(1.7e12)).alias("x"), (F.col("id") * 2.0).alias("y"))
    assert df.agg(s.pearson_zero("x", "y").alias("r")).first().r == pytest.approx(1.0, abs=1e-9)


def test_known_words_in_payloads(spark, monkeypatch):
    """Counts of known words at every byte in both orders; only candidates leave a batch, and collisions are not counted."""
    from eventloom.operators import payload as pl

    monkeypatch.setattr(pl, "SEGMENT", 5)
    payloads = {1: b"abcdabcd\xff\xff\xff\xff", 2: b"dcba", 3: b"abc", 4: None, 5: b"", 6: (1_684_234_849 + pl.PLACES).to_bytes(4, "little"), 7: b"zdcbazabcd"}
    words = [int.from_bytes(b"abcd", "little"), 0xFFFFFFFF, None]
    df = spark.createDataFrame(list(payloads.items()), "id long, payload binary").coalesce(1)
    got = {r.id: (r.little, r.big) for r in pl.known_words(df, ["id"], "payload", spark.createDataFrame([(w,) for w in words], "word long")).collect()}
    assert got == {1: (3, 1), 2: (0, 1), 7: (1, 1)}
