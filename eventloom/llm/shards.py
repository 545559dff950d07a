"""Contiguous shards of near-equal bytes from global prefix sums of sizes."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventloom.llm.common import ROW, parallelism
from eventloom.session import cut_lineage


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in order of their identifier, into ``n_shards`` runs of near-equal bytes.

    The size of a document is the number of UTF-8 bytes of its text (null: none) plus 1. Rows are
    range-partitioned once (identifier, size, checksum; never the text). Every partition sends one
    total; their running sums give each partition its global offset, and a document belongs to the
    shard in which its middle byte falls when the corpus is cut at equal targets.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (position in the shard, from 0)
    and grown_shard (null: this law has none). A null identifier sorts first. Repeated rows each get
    a slot. A document larger than a target leaves shards empty. An empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias(ROW),
    )
    order = ["doc_id", "size", "text_crc32", ROW]
    placed = cut_lineage(narrow.repartitionByRange(parallelism(spark), *order).withColumn("part", F.spark_partition_id()))
    # one row for each partition
    totals = sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect())
    bytes_before = [0, *accumulate(t[1] for t in totals)]
    rows_before = [0, *accumulate(t[2] for t in totals)]
    offsets = spark.createDataFrame(
        [(t[0], bytes_before[i], rows_before[i]) for i, t in enumerate(totals)],
        T.StructType([T.StructField("part", T.IntegerType()), T.StructField("bytes_before", T.LongType()), T.StructField("rows_before", T.LongType())]),
    )
    total = bytes_before[-1]
    so_far = Window.partitionBy("part").orderBy(*order)
    middle = (F.col("bytes_before") + F.sum("size").over(so_far)) * 2 - F.col("size")
    located = (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("shard", F.least(F.floor(middle.cast("decimal(38,0)") * n_shards / F.lit(max(2 * total, 1))), F.lit(n_shards - 1)).cast("int"))
        .withColumn("at", F.col("rows_before") + F.row_number().over(so_far) - 1)
    )
    # n_shards rows
    starts = located.groupBy("shard").agg(F.min("at").alias("first"))
    return located.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
