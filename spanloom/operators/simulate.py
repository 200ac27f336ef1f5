"""A deterministic model: for a profile of pass rates, exactly floor(rate * n + 0.5) of a capability's n probes pass."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shipping import ship

SAID = "Here is an answer in words."


def passing(probes: DataFrame, rates: DataFrame) -> DataFrame:
    """probes (id, capability) with `passes`: those with the lowest hash buckets, as many as the rate asks for; 1 where the profile is silent."""
    by = Window.partitionBy("capability")
    nth = F.row_number().over(by.orderBy(T.hash_bucket(F.col("id")), "id"))
    quota = F.floor(F.coalesce("rate", F.lit(1.0)) * F.count("*").over(by) + 0.5)
    return probes.join(F.broadcast(rates.select("capability", "rate")), "capability", "left").withColumn("passes", nth <= quota).drop("rate")


def _broken(schema: dict, args: dict) -> str:
    """Arguments of a wrong type in one property, or no object at all where the schema constrains none."""
    props = schema.get("properties") or {}
    for key in [*(schema.get("required") or []), *props]:
        rule = props.get(key)
        if isinstance(rule, dict) and (rule.get("enum") or rule.get("type")):
            wrong = "not one of them" if rule.get("enum") else [] if rule["type"] == "string" else "a text"
            return json.dumps({**args, key: wrong})
    return json.dumps("no object")


def _respond(capability: str, passes: bool, expected: str | None, text: str | None, schema: dict, tools: list, reference: dict) -> dict:
    valid = reference.get("valid_args", {})
    names = [t["name"] for t in tools]
    call = lambda name, args: {"content": None, "tool_calls": [{"name": name, "arguments": args if isinstance(args, str) else json.dumps(args)}]}
    say = lambda t: {"content": t, "tool_calls": []}
    expected = expected or reference.get("tool")
    other = next((n for n in names if n != expected), None)
    match capability:
        case "tool_selection" | "traced_tool_selection":
            return call(expected, valid) if passes else say(SAID)
        case "tool_discrimination" | "needle_in_tools":
            return call(expected, valid) if passes else call(other, {}) if other else say(SAID)
        case "arity_robustness":
            full = dict(reference.get("full_args", {}))
            return call(expected, full if passes else dict([*full.items()][1:])) if passes or full else say(SAID)
        case "tool_restraint" | "traced_no_tool":
            return say(SAID) if passes else call(names[0] if names else "needless", {})
        case "tool_permission":
            return say(SAID) if passes else call(expected, valid)
        case "no_hallucinated_tool":
            return say(SAID) if passes else call(reference.get("absent_tool", "absent"), valid)
        case "arg_validity" | "traced_schema_validity":
            return call(expected, valid if passes else _broken(schema, valid))
        case "required_args":
            needed = schema.get("required") or []
            return call(expected, valid) if passes else call(expected, {k: v for k, v in valid.items() if k != needed[0]}) if needed else say(SAID)
        case "structured_output" | "json_mode":
            return say(json.dumps(valid) if passes else f"Sure:\n```json\n{json.dumps(valid)}\n```")
        case "format_adherence":
            return say(text if passes else f"{text}, of course")
    raise ValueError(f"no simulation of {capability}")


def respond(probes: DataFrame) -> DataFrame:
    """probes (with passes) and the simulated response."""
    ship(probes.sparkSession)

    @F.pandas_udf("content string, tool_calls array<struct<name:string,arguments:string>>")
    def make(capability: pd.Series, passes: pd.Series, expected: pd.Series, text: pd.Series, schema: pd.Series, tools: pd.Series, reference: pd.Series) -> pd.DataFrame:
        rows = [_respond(c, bool(p), e, x, json.loads(s) if s else {}, list(t), json.loads(r) if r else {}) for c, p, e, x, s, t, r in zip(capability, passes, expected, text, schema, tools, reference)]
        return pd.DataFrame(rows, columns=["content", "tool_calls"])

    return probes.withColumn("response", make("capability", "passes", "expected_tool", "expected_text", "schema", F.transform("tools", lambda t: F.struct(t["name"].alias("name"))), "reference"))
