"""Small helpers of the llm operators: inputs under fixed names, folds, batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "row__"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) under fixed names, a null text as the empty text; other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the identifier as text, modulo ``n``; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % n


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with at most ``limit`` bytes in ``column`` (one row at least)."""
    start, held = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for at, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def squeezed(docs: DataFrame) -> DataFrame:
    """The other columns of ``docs`` with packed, the text compressed by zstandard, to be shuffled."""
    fields = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            squeeze = zstandard.ZstdCompressor(level=1)
            packed = [squeeze.compress(t.as_py().encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(packed, pa.binary())], names=[*[f.name for f in fields], "packed"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("packed", T.BinaryType())]))


#: What a Python worker remembers: one object at a time, as workers go on from stage to stage.
_KEPT: dict = {}


def kept(name, make):
    """The object of this name in this Python worker; made, in place of any other, when it is not there."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
