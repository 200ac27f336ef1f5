"""The corpus pipeline: quality classifier, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next stage's docs. All but the last
return the columns of docs; the last adds row_number, position, shard and slot. Other tables (labels, benchmark) come from sf_dir.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns are handled as each operator's docstring says: the
classifier drops null and blank texts; of repeated rows the near-duplicate stage keeps one; extra columns pass through every stage, except
that the last replaces columns that have the names it adds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, mixing, quality, shard, simhash
from spanloom.llm.common import table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensembles call good and clean; they are fitted on the labelled rows of the documents table."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each slot that its block has: all of them at least once, those of favoured sources again."""
    return mixing.mixed(docs)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in its shuffled order, with shard and slot."""
    return shard.shards(docs)


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard_rows),
]

ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pipeline-")
    return f"{base}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    folder = _folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
