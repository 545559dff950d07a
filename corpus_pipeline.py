"""Corpus pipeline over ``documents``, and the registration of the llm queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import queries as llm
from eventloom.llm.bpe import encode_documents
from eventloom.llm.common import table
from eventloom.llm.exact import drop_exact_duplicates
from eventloom.llm.minhash import drop_near_duplicates
from eventloom.llm.mixing import mixed
from eventloom.llm.quality import keep_sound
from eventloom.session import checkpoint_folder, ship_library



def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_sound(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents enter as often as their rate says, so that expected tokens per domain match the targets.

    The domains are learned from all documents, as the stages before take most of the poor ones away.
    """
    return mixed(docs, llm.domain_labels(spark, sf_dir), llm.TARGETS, learn_from=table(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    return encode_documents(docs, *llm.vocabulary())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]
#: Stages with trained models cannot be written in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    ship_library(spark)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return docs


def register_llm() -> tuple[dict, dict]:
    """Queries and reference SQL of the llm subpackage, with the pipeline."""
    oracles = dict(llm.ORACLES)
    if ORACLE_SQL is not None:
        oracles["pipeline"] = ORACLE_SQL
    return {**llm.QUERIES, "pipeline": run}, oracles
