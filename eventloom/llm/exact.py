"""Exact duplicates by a tree merge of digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import ROW
from eventloom.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["digest", "n_bytes", "check"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` does the same where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def merge_runs(narrow: DataFrame, fan_in: int = 8) -> DataFrame:
    """Give every row of (key, run, who) the winner and the size of its group.

    Level 0 holds one entry for each digest of each run (the input partition). Every round merges
    ``fan_in`` neighbouring runs into one, keeping for each digest one identifier and a count, until
    one run is left. The answers then go down the same tree, so a digest that holds a third of all
    rows is met once per run, never as one group of rows. The digest counts as verified with the
    byte length and a second hash in the key.
    """
    levels = [cut_lineage(narrow.groupBy(*KEY, "run").agg(F.max("who").alias("who"), F.count(F.lit(1)).alias("n")))]
    last = levels[0].agg(F.max("run")).first()[0] or 0
    while last > 0:
        merged = levels[-1].groupBy(*KEY, F.expr(f"run div {fan_in}").alias("run")).agg(F.max("who").alias("who"), F.sum("n").alias("n"))
        levels.append(cut_lineage(merged))
        last //= fan_in
    answer = levels[-1]
    for level in reversed(levels[:-1]):
        up = answer.withColumnRenamed("run", "up")
        answer = level.select(*KEY, "run", F.expr(f"run div {fan_in}").alias("up")).join(up, [*KEY, "up"]).select(*KEY, "run", "who", "n")
    return narrow.withColumnRenamed("who", "own").join(answer, [*KEY, "run"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest identifier stays (a null identifier is the smallest); of rows that also
    share the identifier exactly one stays. An empty table gives no rows.
    """
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    narrow = cut_lineage(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), norm.alias("norm"), F.monotonically_increasing_id().alias(ROW), F.spark_partition_id().cast("long").alias("run"))
        .select(
            F.struct("doc_id", ROW).alias("who"), F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("check"), "run",
        )
    )
    return merge_runs(narrow, fan_in).select(
        F.col("own.doc_id").alias("doc_id"), F.col("who.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col(f"own.{ROW}") == F.col(f"who.{ROW}")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col(f"own.{ROW}").alias(ROW),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay, columns unchanged; one of rows alike in both."""
    safe = [f"c{i}__" for i in range(len(docs.columns))]
    id_col, text_col = (F.col(safe[docs.columns.index(c)]) for c in ("doc_id", "text"))
    stay = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("id__"), F.unhex("text_sha256").alias("sha__"))
    rows = docs.toDF(*safe).withColumns({"id__": id_col, "sha__": F.unhex(F.sha2(ascii_lower(F.coalesce(text_col, F.lit(""))), 256))})
    found = rows.alias("a").join(stay.alias("b"), F.col("a.id__").eqNullSafe(F.col("b.id__")) & (F.col("a.sha__") == F.col("b.sha__")), "left_semi")
    once = Window.partitionBy("id__", "sha__").orderBy("id__")
    return found.withColumn("copy__", F.row_number().over(once)).filter("copy__ = 1").select(*[F.col(s).alias(c) for s, c in zip(safe, docs.columns)])
