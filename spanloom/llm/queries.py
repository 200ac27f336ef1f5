"""The queries over training data, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, embed, mixing, quality, secrets, shard, simhash, spans, suffix
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shards(table(spark, sf_dir, "documents")).select("doc_id", "row_number", "position", "shard", "slot")


ORACLE_SQL["op1_sharding"] = shard.oracle()


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy tiling has no SQL form; tests hold it against a search of all pairs."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and the Golay code have no SQL form; tests hold the pairs against a search of all pairs."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model is learned, so there is no SQL form; tests hold its column against its arrays, and its verdicts against held-out labels."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_mixing"] = mixing.oracle()


@query
def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shortened(table(spark, sf_dir, "documents"))


ORACLE_SQL["op9_sentence_spans"] = spans.oracle()


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op10_chat"] = chat.oracle()


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


ORACLE_SQL["op3_secrets"] = secrets.oracle()


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort of all suffixes has no practical SQL form; tests hold the spans against a search of all windows."""
    return suffix.repeats(table(spark, sf_dir, "documents"))


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op4_embedding_near_dedup"] = embed.oracle()
