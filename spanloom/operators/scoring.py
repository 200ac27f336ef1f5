"""Scoring: (probe, response) -> 0 or 1 by capability, then pass rates and capability means.

Scorers that look at names are Column expressions. Those that look into arguments against a JSON Schema share one Arrow UDF, which parses each
distinct schema once a batch; rows of other capabilities never reach it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions.shipping import ship

NEGATIVE = ("tool_restraint", "tool_permission", "no_hallucinated_tool", "traced_no_tool")


def _names(calls: Column) -> Column:
    return F.transform(calls, lambda c: c["name"])


def calls_tool(calls: Column, expected: Column) -> Column:
    """Some call of the expected tool; any call where none is expected."""
    return F.when(expected.isNull(), F.size(calls) > 0).otherwise(F.coalesce(F.array_contains(_names(calls), expected), F.lit(False)))


def calls_only(calls: Column, expected: Column) -> Column:
    return F.coalesce(F.array_contains(_names(calls), expected), F.lit(False)) & (F.size(F.array_except(_names(calls), F.array(expected))) == 0)


def no_call(calls: Column) -> Column:
    return F.size(calls) == 0


def avoids(calls: Column, forbidden: Column) -> Column:
    return ~F.coalesce(F.array_contains(_names(calls), forbidden), F.lit(False))


def calls_offered(calls: Column, offered: Column) -> Column:
    return F.size(F.array_except(_names(calls), offered)) == 0


def says(content: Column, expected: Column) -> Column:
    """The same text but for white space at the ends; an empty answer never is."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.coalesce((content != "") & (strip(content) == strip(expected)), F.lit(False))


def _object(text: str | None) -> dict | None:
    try:
        x = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return x if isinstance(x, dict) else None


def _valid_args(schema: dict, args: list[tuple[str, dict]], tools: dict) -> bool:
    return any(S.check(a, schema) for _, a in args)


def _required(schema: dict, args: list, tools: dict) -> bool:
    props = schema.get("properties") or {}
    return any(all(k in a and not S.unfilled(a[k], props.get(k)) for k in schema.get("required", [])) for _, a in args)


def _all_filled(schema: dict, args: list, tools: dict) -> bool:
    props = schema.get("properties") or {}
    return not props or any(S.all_filled(props, a) for _, a in args)


def _own_schema(schema: dict, args: list, tools: dict) -> bool:
    return any(n in tools and S.check(a, tools[n]) for n, a in args)


DEEP: dict[str, Callable[[dict, list, dict], bool]] = {"arg_validity": _valid_args, "required_args": _required, "arity_robustness": _all_filled, "traced_schema_validity": _own_schema}
TEXTS = ("structured_output", "json_mode")


def _deep(capability: pd.Series, schema: pd.Series, expected: pd.Series, calls: pd.Series, tools: pd.Series, content: pd.Series) -> pd.Series:
    parsed: dict[str, dict] = {}
    toolsets: dict[tuple, dict] = {}
    out = []
    for cap, text, name, own, offered, said in zip(capability, schema, expected, calls, tools, content):
        if text not in parsed:
            parsed[text] = json.loads(text) if isinstance(text, str) and text else {}
        rule = parsed[text] or {}
        if cap in TEXTS:
            try:
                out.append(bool(said) and S.check(json.loads(said.strip()), rule))
            except ValueError:
                out.append(False)
            continue
        named = [c for c in (own if own is not None else []) if cap == "traced_schema_validity" or name is None or c["name"] == name]
        args = [(c["name"], a) for c in named if (a := _object(c["arguments"])) is not None]
        key = tuple((t["name"], t["parameters"]) for t in offered) if cap == "traced_schema_validity" and offered is not None else ()
        if key not in toolsets:
            toolsets[key] = {n: json.loads(p) for n, p in key}
        if cap == "arity_robustness" and not named:
            out.append(False)
        elif cap == "arity_robustness" and not rule.get("properties"):
            out.append(True)
        else:
            out.append(DEEP[cap](rule, args, toolsets[key]))
    return pd.Series(out, dtype=bool)


def score(rows: DataFrame) -> DataFrame:
    """rows with `score`. Needs capability, expected_tool, expected_text, schema (JSON text), tools (name, parameters) and response.

    A malformed schema counts as not satisfied. An unknown capability raises.
    """
    ship(rows.sparkSession)
    calls, expected = F.col("response.tool_calls"), F.col("expected_tool")
    deep = F.pandas_udf(_deep, "boolean")
    tools = F.transform("tools", lambda t: F.struct(t["name"].alias("name"), t["parameters"].alias("parameters")))
    args = F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))
    cap = F.col("capability")
    native = (
        F.when(cap.isin("tool_selection", "needle_in_tools", "traced_tool_selection"), calls_tool(calls, expected))
        .when(cap == "tool_discrimination", calls_only(calls, expected))
        .when(cap.isin("tool_restraint", "traced_no_tool"), no_call(calls))
        .when(cap == "tool_permission", avoids(calls, expected))
        .when(cap == "no_hallucinated_tool", calls_offered(calls, F.transform("tools", lambda t: t["name"])))
        .when(cap == "format_adherence", says(F.col("response.content"), F.col("expected_text")))
    )
    is_deep = cap.isin(*DEEP, *TEXTS)
    known = F.when(native.isNull(), F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(cap, F.lit("null")))).cast("boolean")).otherwise(native)
    a = rows.where(~is_deep | cap.isNull()).withColumn("score", known.cast("double"))
    b = rows.where(is_deep).withColumn("score", deep(cap, "schema", "expected_tool", args, tools, "response.content").cast("double"))
    return a.unionByName(b)


def pass_rates(samples: DataFrame) -> DataFrame:
    """(probe_id, capability, score, error, samples) of (probe_id, capability, sample_no, score, error).

    A failed request scores 1 where the capability is about not doing something, else 0. A probe has an error only if every sample failed, the
    last one's.
    """
    bad = F.coalesce(F.col("error") != "", F.lit(False))
    own = F.when(bad, F.col("capability").isin(*NEGATIVE).cast("double")).otherwise(F.col("score"))
    grouped = samples.groupBy("probe_id", "capability").agg(F.avg(own).alias("score"), F.max_by("error", F.when(bad, F.col("sample_no"))).alias("last"), F.count_if(bad).alias("n_bad"), F.count("*").alias("samples"))
    return grouped.select("probe_id", "capability", "score", F.when(F.col("n_bad") == F.col("samples"), F.col("last")).alias("error"), "samples")


def capability_scores(results: DataFrame) -> DataFrame:
    """(capability, score): the mean of the probes' rates, not of the samples."""
    return results.groupBy("capability").agg(F.bround(F.avg("score"), 4).alias("score")).orderBy("capability")


def error_negatives(results: DataFrame) -> DataFrame:
    """(capability, errored, total) of capabilities about not doing something, where an error bought the score."""
    bad = F.coalesce(F.col("error") != "", F.lit(False))
    return results.where(F.col("capability").isin(*NEGATIVE)).groupBy("capability").agg(F.count_if(bad).alias("errored"), F.count("*").alias("total")).where("errored > 0")


def all_errored(results: DataFrame) -> bool:
    """Whether nothing but errors came back, in which case there is no scorecard."""
    return results.agg(F.coalesce(F.bool_and(F.coalesce(F.col("error") != "", F.lit(False))), F.lit(False))).first()[0]


def answer(probes: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """probes joined with one response a distinct request: equal requests are asked once."""
    return probes.join(responses.dropDuplicates(key), key, "left")
