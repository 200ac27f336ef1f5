import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions.stats import critical_value, significant_regression
from spanloom.operators import cluster, compare, health, probes
from spanloom.sources import files


def cards(spark, *scores):
    return [spark.createDataFrame([(c, float(s), n) for c, s, n in rows], "capability string, score double, trials int") for rows in scores]


def test_diff_statuses(spark):
    b, c = cards(spark, [("same", 1, 3), ("edge", 1, 3), ("drop", 1, 3), ("big", 1, 30), ("gone", 0, 3), ("up", 0.5, 3)], [("same", 1, 3), ("edge", 0.95, 3), ("drop", 0.667, 3), ("big", 0.667, 30), ("new", 0, 3), ("up", 0.6, 3)])
    plain = {r.capability: r.status for r in compare.diff(b, c).collect()}
    assert plain == {"same": "ok", "edge": "ok", "drop": "regression", "big": "regression", "gone": "removed", "new": "added", "up": "improved"}
    tested = {r.capability: r.status for r in compare.diff(b, c, confidence=0.95).collect()}
    assert tested == plain | {"drop": "noisy"}
    rows = compare.diff(b, c, confidence=0.95)
    assert compare.gate(rows) == 1 and compare.gate(rows.where("status IN ('ok', 'noisy', 'added')")) == 0 and compare.gate(rows, False, True) == 2


def test_significance(spark):
    cases = [(1.0, 3, 0.667, 3, False), (1.0, 30, 0.667, 30, True), (1.0, 0, 0.5, 3, True), (0.01, 10, 0.0, 10, True), (0.5, 9, 0.5, 9, False), (0.927, 150, 0.853, 150, True), (1.0, 30, 0.7, 30, True), (1.0, 20, 0.9, 20, False), (1.0, 45, 0.33, 45, True)]
    df = spark.createDataFrame(cases, "pb double, nb int, pc double, nc int, want boolean")
    assert df.where(significant_regression(F.col("pb"), F.col("nb"), F.col("pc"), F.col("nc"), 0.95) != F.col("want")).count() == 0
    assert critical_value(0.95) == pytest.approx(1.6448536269514715)


def test_trend(spark):
    ladders = {"a": [1, 1, 0.67, 0.33], "b": [1, 0.4, 1, 1], "c": [0.9, 0.9, 0.9, None], "d": [None, None, None, 0.9], "e": [0.9, None, 0.9, 0.9], "f": [0.5, 0.6, 0.7, 0.8]}
    rows = [(c, k, float(v)) for c, vs in ladders.items() for k, v in enumerate(vs) if v is not None]
    got = {r.capability: r for r in compare.trend(spark.createDataFrame(rows, "capability string, pos int, score double"), 4).collect()}
    assert {c: r.status for c, r in got.items()} == {"a": "regressed", "b": "unstable", "c": "removed", "d": "partial", "e": "stable", "f": "improved"}
    assert (got["a"].delta, got["a"].worst_step, got["a"].monotonic) == (-0.67, -0.34, True) and got["e"]["values"] == [0.9, None, 0.9, 0.9] and not got["b"].monotonic


def test_health_and_drift(spark):
    tools = spark.createDataFrame([("a", "", "{}"), ("a", "", '{"properties": {"x": {"type": "string"}}}')], "name string, description string, parameters string")
    assert {(r.level, r.code) for r in health.toolset_health(tools).collect()} == {("error", "duplicate-tool"), ("warn", "few-tools"), ("warn", "no-args")}
    live = spark.createDataFrame([("a", '{"type":"object","required":["p","q"]}'), ("b", "{}")], "name string, parameters string")
    frozen = spark.createDataFrame([("a", '{"required":["q","p"],"type":"object"}'), ("a", '{"type":"object"}'), ("z", None), ("b", None)], "tool string, schema string")
    assert {(r.code, r.message.split()[-2]) for r in health.drift(live, frozen).collect()} == {("schema-drift", "2"), ("tool-removed", "use")}


def test_leaders_by_hand(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want, heads = {}, []
    for k in range(60):
        want[k] = next((h for h in heads if unit[h] @ unit[k] >= 0.8), k)
        if want[k] == k:
            heads.append(k)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key bigint, vec array<double>")
    assert {r.key: r.leader for r in cluster.leaders(df, 0.8).collect()} == want


def test_scorecard_files(spark, tmp_path):
    card = files.scorecard({"capabilities": {"a": 1, "b": 0.5}, "results": [{"probe_id": "p", "capability": "a", "score": "bad"}, 7, {"probe_id": "q", "capability": "a", "score": 1, "error": "e"}], "samples": 0, "label": "x"})
    assert card["samples"] == 1 and card["results"][0]["score"] == 0.0 and card["n_probes"] == 2
    files.write_scorecard(card, str(tmp_path / "d" / "one.json"))
    back = files.read_scorecards(spark, [str(tmp_path / "d" / "one.json")])
    assert {(r.capability, r.score, r.trials) for r in files.scores(back).collect()} == {("a", 1.0, 2), ("b", 0.5, 0)}
    for bad in ({}, {"capabilities": {"a": "x"}}, {"capabilities": {}, "lockfile_format": 2}):
        with pytest.raises(ValueError):
            files.scorecard(bad)


def test_mined_files_and_trust(spark, tmp_path):
    tool = {"type": "function", "function": {"name": "f", "parameters": {"type": "object"}}}
    rows = [{"id": k, "category": c, "messages": [{"role": "user", "content": "q"}], "tools": [tool], "tool": "f" if c != "no_tool" else None, "status": "pending", "provenance": {"sessions": 2}} for k, c in (("1", "schema_validity"), ("2", "tool_selection"), ("3", "no_tool"))]
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"version": 1, "probes": rows}))
    m = files.load_mined(spark, str(path))
    assert {r.id: r.status for r in probes.auto_accept(m).collect()} == {"1": "accepted", "2": "pending", "3": "pending"}
    both = probes.auto_accept(m, ("tool_selection", "no_tool"))
    assert {r.id: r.status for r in both.collect()} == {"1": "pending", "2": "accepted", "3": "pending"}
    assert probes.auto_accept(m, everything=True).where("status = 'accepted'").count() == 3
    assert [(r.id, r.capability, r.expected_tool, r.schema) for r in probes.from_mined(both).collect()] == [("2", "traced_tool_selection", "f", '{"type":"object"}')]
    assert probes.from_mined(both, allow_sensitive=False).count() == 0
    files.save_mined(m, str(tmp_path / "out.json"), {"note": "n"})
    assert files.load_mined(spark, str(tmp_path / "out.json")).count() == 3
    assert probes.edit_tool(m, "2", "f").where("id = '2'").first().provenance.edited_from == "f"
    with pytest.raises(ValueError):
        probes.edit_tool(m, "2", "other")
    for change in ({"category": "x"}, {"status": "x"}, {"tool": None, "category": "tool_selection"}, {"id": "2"}):
        path.write_text(json.dumps({"probes": [rows[0] | change, rows[1]] if change != {"id": "2"} else [rows[1], rows[1]]}))
        with pytest.raises(ValueError):
            files.load_mined(spark, str(path))
    assert health.frozen_tools(m).count() == 2


def test_recorded_checks(spark, tmp_path):
    tool = {"type": "function", "function": {"name": "f", "parameters": {"type": "object", "properties": {"x": {"type": "integer"}}}}}
    records = [{"id": "r1", "messages": [], "tools": [tool], "response": {"tool_calls": [{"name": "f", "arguments": "{}"}]}}, {"messages": [], "tools": [tool], "response": {"content": '{"x": 3}'}}, {"id": "r3", "tools": [tool], "response": {"tool_calls": [{"name": "other"}]}}]
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"version": 1, "records": records}))
    got = probes.derive_traced(files.read_records(spark, str(path))).collect()
    assert sorted(r.capability for r in got) == ["arg_validity", "required_args", "structured_output", "tool_discrimination", "tool_selection"]
    assert all(len(r.record) == 12 for r in got if r.capability == "structured_output")
    path.write_text(json.dumps({"records": [records[0], records[0]]}))
    with pytest.raises(ValueError):
        files.read_records(spark, str(path))
