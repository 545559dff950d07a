"""Framed binary segments to packet rows.

A segment is independent of the others, so it is the unit of work: one binary row in, its
packets out. A broken block ends its segment: the blocks before it are kept and one error row
says what was wrong. The byte layout is fixed by the format:

marker u8: 0x80 time is a u8 delta in ms (else f32 seconds), 0x40 type inherited (else u16),
0x20 parameter is an i8 delta (else u32), 0x10 length is u8 (else u32), 0x0F channel;
then time, length, type, parameter, payload; all little-endian.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPACT_TIME, SAME_TYPE, PARAM_DELTA, SHORT_LENGTH, CHANNEL = 0x80, 0x40, 0x20, 0x10, 0x0F
PACKET_COLUMNS = (
    "is_error boolean, block_index int, channel int, ts_seconds double, content_length long, packet_type int,"
    " block_param long, header_offset long, content_offset long, end_offset long, payload binary,"
    " code string, error_offset long, expected_bytes long, available_bytes long"
)
NAMES = [c.strip().split(" ")[0] for c in PACKET_COLUMNS.split(",")]


class Broken(Exception):
    def __init__(self, code: str, at: int, want: int = 0, have: int = 0, length: int | None = None):
        super().__init__(code)
        self.code, self.at, self.want, self.have, self.length = code, at, want, have, length


def parse_segment(data: bytes) -> Iterator[tuple]:
    """Rows of one segment in ``NAMES`` order."""
    at, index, now, kind, param = 0, 0, 0.0, None, None
    while at < len(data):
        head = at

        def take(fmt: str, what: str):
            nonlocal at
            size = struct.calcsize(fmt)
            if at + size > len(data):
                raise Broken(f"truncated-{what}", at, size, len(data) - at)
            (value,) = struct.unpack_from(fmt, data, at)
            at += size
            return value

        length = None
        try:
            marker = take("<B", "marker")
            if marker & COMPACT_TIME:
                stamp = now + take("<B", "time") / 1000.0
            else:
                stamp = take("<f", "time")
                if not math.isfinite(stamp):
                    raise Broken("non-finite-time", at - 4)
            length = take("<B" if marker & SHORT_LENGTH else "<I", "length")
            if marker & SAME_TYPE:
                if kind is None:
                    raise Broken("missing-inherited-type", at)
                new_kind = kind
            else:
                new_kind = take("<H", "type")
            if marker & PARAM_DELTA:
                if param is None:
                    raise Broken("missing-inherited-param", at)
                new_param = (param + take("<b", "param")) & 0xFFFFFFFF
            else:
                new_param = take("<I", "param")
            if at + length > len(data):
                raise Broken("truncated-payload", at, length, len(data) - at)
        except Broken as e:
            yield (True, index, None, None, length, None, None, head, None, None, None, e.code, e.at, e.want, e.have)
            return
        now, kind, param = stamp, new_kind, new_param
        yield (
            False, index, marker & CHANNEL, now, length, kind, param, head, at, at + length, data[at : at + length],
            None, None, None, None,
        )
        at += length
        index += 1


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Binary segment files as (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def parse_packets(segments: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Packet rows and error rows (``is_error``) of every segment."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + PACKET_COLUMNS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                head = [getattr(row, k) for k in keys]
                rows = [(*head, *r) for r in parse_segment(bytes(getattr(row, content)))]
                if rows:
                    yield pd.DataFrame(rows, columns=[*keys, *NAMES]).convert_dtypes()

    return segments.select(*keys, content).mapInPandas(run, ddl)


def packets(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("is_error")).drop("is_error", "code", "error_offset", "expected_bytes", "available_bytes")


def packet_errors(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parsed.filter("is_error").select(
        *keys, "code", "block_index", F.col("header_offset").alias("block_offset"), "error_offset", "expected_bytes",
        "available_bytes", F.col("content_length").alias("declared_content_length"),
    )


def framing_report(parsed: DataFrame, sizes: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Segments, blocks, bytes, errors and exactly-consumed segments per version."""
    per = parsed.groupBy(*keys).agg(
        F.count_if(~F.col("is_error")).alias("blocks"), F.count_if("is_error").alias("errors"), F.max("end_offset").alias("used")
    )
    j = sizes.join(per, list(keys), "left")
    exact = (F.coalesce("used", F.lit(0)) == F.col("bytes")) & (F.coalesce("errors", F.lit(0)) == 0)
    return j.groupBy(*version).agg(
        F.count("*").alias("segments"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.sum("bytes").alias("bytes"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.count_if(exact).alias("exactly_consumed"),
    )
