"""What the queries share: tables, the registry, and the views of traffic that the base tables give.

The base tables have no tool calls, so they stand in: `conversations` for message logs, `events` for calls (the user is the session, the event type
the called tool, `error` a failed sample, props the arguments), `labels` for outcomes of trials, `part` for a toolset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with its oracle."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACES = f"'{T.SPACE}'"
TS = T.TIMESTAMP_RE2


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{TS}', '<ts>', 'g'), {SPACES}, ' ', 'g'))"


def exchanges(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """An exchange for each assistant turn: what came before it, and the turn."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    message = F.struct("role", F.concat_ws(":", "role", T.norm_text(F.col("text"))).alias("norm"), T.norm_text(F.col("text")).alias("said"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.collect_list(message).over(order).alias("messages"))
    c = c.where("role = 'assistant' AND size(messages) > 0")
    sid = F.col("conv_id").cast("string") if labelled else F.lit(None).cast("string")
    return c.select("conv_id", F.col("turn").alias("at"), sid.alias("session_id"), F.lit("").alias("ts"), F.lit(0).alias("file_ord"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), "messages", F.transform("messages", lambda m: m["norm"]).alias("norm"), T.norm_text(F.col("text")).alias("reply"))


EXCHANGES_SQL = f"""
turns AS (SELECT conv_id, turn, role, text, {norm_sql("text")} AS said FROM conversations),
ctx AS (
  SELECT conv_id, turn AS at_turn, role, said AS reply, list(role || ':' || said) OVER w AS norm, list(role) OVER w AS roles, list(said) OVER w AS saids
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ex AS (SELECT * FROM ctx WHERE role = 'assistant' AND len(norm) > 0)"""
