"""Toolset health and drift between recorded and live schemas. Tools are rows (name, description, parameters = JSON text)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.shipping import ship

MIN_TOOLS = 3


def canonical_udf():
    @F.pandas_udf("string")
    def canonical(text: pd.Series) -> pd.Series:
        known = {t: S.canonical(json.loads(t)) for t in text.dropna().unique()}
        return text.map(known)

    return canonical


def falsifiable_udf():
    @F.pandas_udf("boolean")
    def falsifiable(text: pd.Series) -> pd.Series:
        known = {t: S.args_falsifiable(json.loads(t)) for t in text.dropna().unique()}
        return text.map(known).fillna(False).astype(bool)

    return falsifiable


def duplicates(tools: DataFrame) -> DataFrame:
    return tools.groupBy("name").count().where("count > 1").select("name").orderBy("name")


def _finding(df: DataFrame, level: str, code: str, *message) -> DataFrame:
    return df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), F.concat(*message).alias("message"))


def toolset_health(tools: DataFrame) -> DataFrame:
    """(level, code, message): duplicate names, too few tools to tell apart, tools without arguments, arguments that nothing can break."""
    ship(tools.sparkSession)
    props = F.try_variant_get(F.try_parse_json("parameters"), "$.properties", "map<string,variant>")
    each = tools.withColumn("n", F.coalesce(F.size(F.map_keys(props)), F.lit(0))).withColumn("checked", falsifiable_udf()("parameters"))
    few = tools.agg(F.count("*").alias("n")).where(F.col("n") < MIN_TOOLS)
    name = F.col("name")
    found = _finding(duplicates(tools), "error", "duplicate-tool", F.lit("more than one tool is called "), name)
    found = found.unionByName(_finding(few, "warn", "few-tools", F.lit("only "), F.col("n").cast("string"), F.lit(" tools: picking the right one proves little")))
    found = found.unionByName(_finding(each.where("n <= 0"), "warn", "no-args", name, F.lit(" takes no arguments")))
    return found.unionByName(_finding(each.where("n > 0 AND NOT checked"), "warn", "unconstrained-args", name, F.lit(" accepts any arguments")))


def drift(live: DataFrame, frozen: DataFrame) -> DataFrame:
    """(level, code, message) of frozen (tool, schema) rows against the live toolset. Order within unordered arrays is no drift.
    Of live tools with one name the first counts, by a column `place` if there is one, otherwise by their schemas."""
    ship(live.sparkSession)
    canonical = canonical_udf()
    place = F.col("place") if "place" in live.columns else F.lit(0)
    now = live.groupBy("name").agg(F.min_by("parameters", F.struct(place, "parameters")).alias("p")).select(F.col("name").alias("tool"), canonical("p").alias("now"), F.lit(True).alias("there"))
    then = frozen.withColumn("then", canonical(F.coalesce("schema", F.lit("{}"))))
    by = then.join(now, "tool", "left").groupBy("tool").agg(F.count("*").alias("n"), F.count_if(F.col("then") != F.col("now")).alias("stale"), F.bool_or(F.col("there").isNull()).alias("gone"))
    gone = _finding(by.where("gone"), "error", "tool-removed", F.col("tool"), F.lit(" is gone, but "), F.col("n").cast("string"), F.lit(" checks use it"))
    return gone.unionByName(_finding(by.where("NOT gone AND stale > 0"), "warn", "schema-drift", F.lit("the schema of "), F.col("tool"), F.lit(" changed since "), F.col("stale").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" checks")))


def recorded_tools(records: DataFrame) -> DataFrame:
    """(tool, schema) that recordings were made with: of the called tool, or of the one whose schema a recorded text satisfies."""
    from .probes import satisfied

    call = F.get("response.tool_calls", F.lit(0))["name"]
    called = records.where(call.isNotNull()).select(F.get(F.filter("tools", lambda t: t["name"] == call), F.lit(0)).alias("t"))
    said = records.where((F.size("response.tool_calls") == 0) & F.col("response.content").isNotNull()).select(satisfied(records).alias("t"))
    return called.unionByName(said).where("t IS NOT NULL").select(F.col("t.name").alias("tool"), F.coalesce("t.parameters", F.lit("{}")).alias("schema"))


def frozen_tools(mined: DataFrame) -> DataFrame:
    """(tool, schema) that mined checks were recorded with; tools are raw JSON definitions."""
    each = mined.where("tool IS NOT NULL").select("tool", F.explode("tools").alias("raw"))
    f = F.try_parse_json("raw")
    return each.where(F.try_variant_get(f, "$.function.name", "string") == F.col("tool")).select("tool", F.coalesce(F.to_json(F.try_variant_get(f, "$.function.parameters", "variant")), F.lit("{}")).alias("schema"))
