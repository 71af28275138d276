"""The corpus pipeline: quality filter, near-dedup, secret redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor, whose result is written as Parquet to the
shared folder and reread; all but the last return the columns of documents. The result is one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import materialize
from palimpsest.llm.mixing import mixed_documents
from palimpsest.llm.neardup import drop_near_duplicates
from palimpsest.llm.packing import harmonic_pack
from palimpsest.llm.quality import accepted_documents
from palimpsest.llm.queries import ranks, table
from palimpsest.llm.secrets import redact_secrets, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs, train(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return harmonic_pack(docs, ranks())


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("secret scans", secrets), ("mixing to target weights", mix), ("packing", pack)]
ORACLE_SQL = None  # no stage is SQL-expressible; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
