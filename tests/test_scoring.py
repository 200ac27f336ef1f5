import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import schema as S
from spanloom.operators import probes, scoring, simulate

CITY = {"type": "object", "properties": {"city": {"type": "string"}, "days": {"type": "integer", "minimum": 1}}, "required": ["city"]}
ROW = "capability string, expected_tool string, expected_text string, schema string, tools array<struct<name:string,description:string,parameters:string>>, response struct<content:string,tool_calls:array<struct<name:string,arguments:string>>>"


def row(capability, calls=(), content=None, expected="f", text=None, schema=CITY, tools=("f", "g")):
    return (capability, expected, text, json.dumps(schema) if schema is not None else None, [(t, "", json.dumps(schema or {})) for t in tools], (content, [(n, a if isinstance(a, str) else json.dumps(a)) for n, a in calls]))


CASES = [
    (row("tool_selection", [("g", {}), ("f", {})]), 1), (row("tool_selection", [("g", {})]), 0), (row("tool_selection", [("g", {})], expected=None), 1), (row("tool_selection"), 0),
    (row("tool_discrimination", [("f", {}), ("f", {})]), 1), (row("tool_discrimination", [("f", {}), ("g", {})]), 0), (row("tool_discrimination"), 0),
    (row("needle_in_tools", [("f", {})]), 1), (row("tool_restraint"), 1), (row("tool_restraint", [("f", {})]), 0), (row("traced_no_tool", content="x"), 1),
    (row("tool_permission", [("g", {})]), 1), (row("tool_permission", [("f", {})]), 0),
    (row("no_hallucinated_tool", [("f", {})]), 1), (row("no_hallucinated_tool", [("zz", {})]), 0), (row("no_hallucinated_tool"), 1), (row("no_hallucinated_tool", [("", {})]), 0),
    (row("arg_validity", [("f", {"city": 1}), ("f", {"city": "x"})]), 1), (row("arg_validity", [("g", {"city": "x"})]), 0), (row("arg_validity", [("f", "not json")]), 0), (row("arg_validity", [("f", {"city": "x", "days": 0})]), 0), (row("arg_validity", [("f", {"city": "x", "days": True})]), 0),
    (row("required_args", [("f", {"city": 5})]), 1), (row("required_args", [("f", {"city": ""})]), 0), (row("required_args", [("f", {"city": None})]), 0), (row("required_args", [("f", {})], schema={}), 1), (row("required_args", [("f", {"city": ""})], schema={"required": ["city"], "properties": {"city": {"maxLength": 0}}}), 1),
    (row("arity_robustness", [("f", {"city": "x", "days": 0})]), 1), (row("arity_robustness", [("f", {"city": "x"})]), 0), (row("arity_robustness", [("f", {})], schema={}), 1), (row("arity_robustness", schema={}), 0),
    (row("structured_output", content=' {"city": "x"}\n'), 1), (row("structured_output", content='```{"city": "x"}```'), 0), (row("structured_output", content='{"city": 2}'), 0), (row("structured_output"), 0), (row("json_mode", content="[1]", schema={"type": "array"}), 1),
    (row("format_adherence", content=" YES \n", text="YES"), 1), (row("format_adherence", content="yes", text="YES"), 0), (row("format_adherence", content="", text=""), 0), (row("format_adherence", content="x"), 0),
    (row("traced_schema_validity", [("g", {"city": "x"})], expected=None), 1), (row("traced_schema_validity", [("h", {"city": "x"})]), 0), (row("traced_tool_selection", [("f", {})]), 1),
    (row("arg_validity", [("f", {"city": "x"})], schema={"type": "nonsense"}), 0), (row("traced_schema_validity", [("f", {})], schema={"type": 7}), 0),
]


def test_every_scorer(spark):
    df = spark.createDataFrame([(k, *r) for k, (r, _) in enumerate(CASES)], "k int, " + ROW)
    got = {r.k: r.score for r in scoring.score(df).collect()}
    assert [k for k, (_, want) in enumerate(CASES) if got[k] != want] == []
    with pytest.raises(Exception, match="no scorer"):
        scoring.score(spark.createDataFrame([row("unheard_of")], ROW)).collect()


def test_pass_rates_and_errors(spark):
    rows = [("a", "tool_selection", 0, 1.0, None), ("a", "tool_selection", 1, 0.0, None), ("a", "tool_selection", 2, 1.0, "boom"), ("b", "tool_restraint", 0, 0.0, "x"), ("b", "tool_restraint", 1, 0.0, "y"), ("c", "tool_selection", 0, 1.0, "")]
    r = scoring.pass_rates(spark.createDataFrame(rows, "probe_id string, capability string, sample_no int, score double, error string"))
    got = {x.probe_id: x for x in r.collect()}
    assert got["a"].score == pytest.approx(1 / 3) and got["a"].error is None and (got["b"].score, got["b"].error) == (1.0, "y") and got["c"].error is None
    assert {x.capability: x.score for x in scoring.capability_scores(r).collect()} == {"tool_selection": 0.6667, "tool_restraint": 1.0}
    assert [(x.capability, x.errored, x.total) for x in scoring.error_negatives(r).collect()] == [("tool_restraint", 1, 1)]
    assert not scoring.all_errored(r) and scoring.all_errored(r.where("probe_id = 'b'")) and not scoring.all_errored(r.limit(0))


TOOLS = [{"type": "function", "function": {"name": n, "description": f"Does {n}.", "parameters": p}} for n, p in (("mail", {"type": "object", "properties": {"to": {"type": "array", "items": {"type": "string", "format": "email"}, "minItems": 1}, "subject": {"type": "string"}, "cc": {"type": "string"}}, "required": ["to", "subject"]}), ("find", CITY), ("now", {"type": "object", "properties": {"zone": {"enum": ["UTC", "CET"]}, "at": {"type": "integer", "multipleOf": 15, "minimum": 20}}, "required": ["zone"]}))]


@pytest.mark.parametrize("json_mode", [False, True])
def test_battery_and_simulation_meet_the_profile(spark, json_mode):
    battery = probes.derive(spark, TOOLS, json_mode).cache()
    assert battery.count() == (10 if json_mode else 9) * 3 + 5 and battery.select("id").distinct().count() == battery.count()
    sizes = {r.capability: r.n for r in battery.select("capability", F.size("tools").alias("n")).distinct().collect()}
    assert sizes["needle_in_tools"] == 18 and sizes["arity_robustness"] == 1 and sizes["no_hallucinated_tool"] == 2 and sizes["structured_output"] == 0
    for rates, want in (([], {}), ([(c, 0.67) for c in scoring.DEEP] + [("tool_selection", 0.67), ("tool_discrimination", 0.33), ("structured_output", 0.0), ("format_adherence", 0.5), ("tool_restraint", 0.33), ("tool_permission", 0.0)], {"tool_selection": 0.6667, "tool_discrimination": 0.3333, "arg_validity": 0.6667, "required_args": 0.6667, "arity_robustness": 0.6667, "structured_output": 0.0, "format_adherence": 0.5, "tool_restraint": 0.3333, "tool_permission": 0.0})):
        profile = spark.createDataFrame(rates, "capability string, rate double")
        scored = scoring.score(simulate.respond(simulate.passing(battery, profile)))
        got = {r.capability: r.score for r in scoring.capability_scores(scored.select(F.col("id").alias("probe_id"), "capability", "score")).collect()}
        assert got == {c: want.get(c, 1.0) for c in got} and len(got) == (12 if json_mode else 11)


def test_duplicate_tools_are_refused(spark):
    with pytest.raises(ValueError, match="mail"):
        probes.derive(spark, [*TOOLS, TOOLS[0]])


SCHEMAS = [
    CITY, {"type": "object", "properties": {"a": {"$ref": "#/$defs/x"}}, "required": ["a"], "$defs": {"x": {"type": "array", "items": {"enum": [3, 4]}, "minItems": 2}}}, {"allOf": [{"type": "object", "required": ["p"]}, {"properties": {"p": {"const": None}}}], "required": ["q"], "properties": {"q": {"type": "number", "exclusiveMinimum": 2, "multipleOf": 0.5}}},
    {"properties": {"s": {"type": "string", "minLength": 30}, "d": {"type": "string", "format": "date"}, "n": {"type": "integer", "maximum": -3}, "o": {"anyOf": [{"type": "boolean"}, {"type": "string"}]}}, "required": ["s", "d", "n", "o"]},
    {"properties": {"self": {"$ref": "#"}}, "required": ["self"]}, {"properties": {"t": {"type": ["null", "integer"], "minimum": 7}}, "required": ["t"]},
]


def test_synthesized_values_are_valid():
    for s in SCHEMAS:
        if "self" not in s.get("properties", {}):  # no finite value satisfies that one; synthesis must still end
            assert S.check(S.synth_args(s), s) or "allOf" in s
            assert S.check(S.synth(s), s)
    assert S.synth(SCHEMAS[4]) and S.synth_all_args(CITY) == {"city": "example", "days": 1}


def test_validator():
    yes, no = (lambda v, s: S.check(v, s)), (lambda v, s: not S.check(v, s))
    assert yes(1.0, {"type": "integer"}) and no(1.5, {"type": "integer"}) and no(True, {"type": "integer"}) and no(True, {"const": 1}) and yes(1.0, {"enum": [1]})
    assert no([1, 1.0], {"uniqueItems": True}) and yes([1, True], {"uniqueItems": True}) and yes(0.3, {"multipleOf": 0.1}) and no({"x": 1}, {"additionalProperties": False})
    assert yes({"a": 1}, {"oneOf": [{"required": ["a"]}, {"required": ["b"]}]}) and no({"a": 1, "b": 1}, {"oneOf": [{"required": ["a"]}, {"required": ["b"]}]}) and no(3, {"not": {"type": "number"}})
    assert yes("not a date", {"format": "date"}) and no("abc", {"pattern": "^b"}) and no(1, False) and yes(1, True) and no(1, {"$ref": "#/nowhere"})


def test_canonical_and_falsifiable():
    assert S.canonical({"required": ["a", "b"], "type": "object"}) == S.canonical({"type": "object", "required": ["b", "a"]}) != S.canonical({"type": "object", "required": ["a"]})
    assert not S.args_falsifiable({"type": "object", "properties": {"q": {"description": "x"}}}) and S.args_falsifiable({"properties": {"q": {"type": "string"}}}) and S.args_falsifiable({"required": ["q"]}) and not S.args_falsifiable({})


def test_redaction():
    schema = {"properties": {"free": {"type": "string"}, "when": {"format": "date"}, "kind": {"enum": ["a"]}, "in": {"type": "object", "properties": {"x": {"const": "c"}}}, "l": {"items": {"type": "string"}}}}
    got = S.redact_args({"free": "héllo😀", "when": "2020-05-05", "kind": "a", "in": {"x": "c", "y": "zz"}, "l": ["ab", 3], "n": 5}, schema)
    assert got == {"free": "<str:6ch>", "when": S.FORMATS["date"], "kind": "a", "in": {"x": "c", "y": "<str:2ch>"}, "l": ["<str:2ch>", 3], "n": 5}
