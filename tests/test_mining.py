import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import mining, sessions
from spanloom.sources import logs

WEATHER = {"type": "function", "function": {"name": "get_weather", "description": "Weather of a city", "parameters": {"type": "object", "properties": {"city": {"type": "string"}}, "required": ["city"]}}}
FILES = {"type": "function", "function": {"name": "search_files", "description": "Find files", "parameters": {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}}}


def user(t):
    return {"role": "user", "content": t}


def call(name, **args):
    return {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "type": "function", "function": {"name": name, "arguments": json.dumps(args)}}]}


def result(t, **more):
    return {"role": "tool", "content": t} | more


def record(messages, reply, session=None, ts="", status=200, choice="auto", tools=(WEATHER, FILES)):
    return {"v": 1, "ts": ts, "session_id": session, "model": "m", "request": {"messages": messages, "tools": [*tools], "tool_choice": choice}, "response": {"message": reply}, "meta": {"status": status}}


def text(t):
    return {"role": "assistant", "content": t}


@pytest.fixture()
def read(spark, tmp_path):
    def go(records, fmt="auto", name="log.jsonl"):
        path = tmp_path / name
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
        return logs.read_logs(spark, str(path), fmt)

    return go


def sample_log():
    ask = [user("weather in Oslo?")]
    find = [user("find the report")]
    hello = [user("just say hello")]
    money = [user("convert ten euros")]
    return [
        record(ask, call("get_weather", city="Oslo"), "s1"),
        record([*ask, call("get_weather", city="Oslo"), result("4 degrees"), user("thanks, and tomorrow?")], text("Colder."), "s1"),
        record(find, call("search_files", query="report"), "s2"),
        record([*find, call("search_files", query="report"), result("Error: no index")], call("search_files", query="the report"), "s2"),
        *[record(hello, text("hello"), f"h{k}") for k in range(3)],
        *[record(money, call("get_weather", city="x"), f"m{k}") for k in range(2)],
        record([user("down")], text("x"), "s9", status=502),
        record([user("forced")], call("get_weather", city="y"), "s10", choice={"type": "function"}),
    ]


def test_sample_log(spark, read):
    all_rows = read([*sample_log(), "{broken", ""])
    assert {r.skip_reason: r["count"] for r in logs.skip_counts(all_rows).collect()} == {"failed_status": 1, "malformed": 1}
    rows = logs.usable(all_rows)
    assert rows.count() == 10
    mined, summary = mining.mine(rows)
    got = {(r.category, r.tool, r.provenance.rule): r for r in mined.collect()}
    kinds = [k[0] for k in got]
    assert (kinds.count("tool_selection"), kinds.count("no_tool")) == (2, 1)
    assert got["tool_selection", "get_weather", "continuation"].id == "trace:s1:t0"
    assert got["no_tool", None, "min-agreement-notool"].provenance.sessions == 3
    counts = {(r.counter, r.name): r["count"] for r in summary.collect()}
    assert counts["skipped", "forced_tool_choice"] == 1 and counts["total", "sessions"] == 8 and counts["clusters", "unconfirmed_tool_clusters"] == 2
    assert all(r.sensitive and r.status == "pending" and r.provenance.source == "log.jsonl" for r in got.values())
    frozen = got["tool_selection", "get_weather", "continuation"]
    assert json.loads(frozen.reference) == {"tool": "get_weather", "valid_args": {"city": "<str:4ch>"}}


def test_redaction_of_context(spark, read):
    log = [record([user("mail a@b.org"), call("get_weather", city="Oslo"), result("ok"), user("and c@d.org?")], call("get_weather", city="Rome"), f"s{k}") for k in range(2)]
    mined, _ = mining.mine(logs.usable(read(log)), mining.Config(redact_patterns=("emails",)))
    r = mined.where("category = 'tool_selection'").first()
    said = [json.loads(m) for m in r.messages]
    assert said[0]["content"] == "mail <email>" and said[3]["content"] == "and <email>?" and not r.sensitive
    assert json.loads(said[1]["tool_calls"][0]["function"]["arguments"]) == {"city": "<str:4ch>"}
    with pytest.raises(ValueError):
        mining.mine(logs.usable(read(log)), mining.Config(redact_patterns=("names",)))


def evidence(read, *records):
    rows = logs.usable(read([*records])).withColumn("norm", F.transform("messages", lambda m: m["norm"]))
    return {r.turn: r for r in sessions.with_evidence(sessions.stitch(rows)).collect()}


def test_continuation_rules(read):
    ask = [user("weather?")]
    done = [*ask, call("get_weather", city="A"), result("fine")]
    first = record(ask, call("get_weather", city="A"), "s")
    assert evidence(read, first, record(done, text("It is fine."), "s"))[0].confirmed
    assert not evidence(read, first)[0].confirmed
    assert not evidence(read, first, record([*ask, call("get_weather", city="A"), result('{"error": "no"}')], text("x"), "s"))[0].confirmed
    assert evidence(read, first, record([*ask, call("get_weather", city="A"), result('{"error": ""}')], text("x"), "s"))[0].confirmed
    assert not evidence(read, first, record(done, call("get_weather", city="B"), "s"))[0].confirmed  # a retry
    assert evidence(read, first, record(done, call("get_weather", city="A"), "s"))[0].confirmed
    moved = [*done, text("ok"), user("next")]
    assert evidence(read, first, record(moved, call("get_weather", city="B"), "s"))[0].confirmed  # after the user went on
    assert not evidence(read, first, record([*done, text("ok"), user(" weather? ")], text("x"), "s"))[0].confirmed
    later = evidence(read, record(ask, text("hm"), "s"), record([*ask, text("hm"), user("weather?")], text("y"), "s"))
    assert later[0].reasked and not later[1].reasked


def test_clock_readings_dont_split_a_conversation(read):
    a = record([{"role": "system", "content": "It is 2024-05-01T10:00:00Z"}, user("hi")], text("hello"))
    b = record([{"role": "system", "content": "It  is 2024-05-01T10:07:11Z"}, user("hi"), text("hello"), user("more")], text("yes"))
    rows = evidence(read, a, b)
    assert rows[0].session_id == rows[1].session_id


def greedy(rows):
    """Sessions by the rule itself: a walk over open tails, as groups of row numbers."""
    open_ = []
    by = {}
    for k, (sid, norm, ts) in enumerate(rows):
        if sid:
            by.setdefault(sid, []).append(k)
    order = lambda k: (len(rows[k][1]), rows[k][2], k)
    for own in by.values():
        open_.append(sorted(own, key=order))
    for k in sorted((k for k, r in enumerate(rows) if not r[0]), key=order):
        norm = rows[k][1]
        best = None
        for s in open_:
            tail = rows[s[-1]][1]
            if norm[: len(tail)] == tail and (best is None or len(tail) > len(rows[best[-1]][1])):
                best = s
        best.append(k) if best is not None else open_.append([k])
    merged = {}
    for s in open_:
        name = next((rows[k][0] for k in s if rows[k][0]), None) or json.dumps(rows[s[0]][1])
        merged.setdefault(name, set()).update(s)
    return {frozenset(s) for s in merged.values()}


@pytest.mark.parametrize("labels", [0, 0.3])
def test_stitching_is_the_greedy_walk(spark, labels):
    rng = random.Random(5)
    for round_ in range(4):
        rows = []
        for _ in range(60):
            norm = [rng.choice("ab") for _ in range(rng.randint(1, 6))]
            rows.append((rng.choice("XYZ") if rng.random() < labels else None, norm, rng.choice("12")))
        df = spark.createDataFrame([(s, n, t, 0, k) for k, (s, n, t) in enumerate(rows)], "session_id string, norm array<string>, ts string, file_ord int, line_no bigint")
        got = {}
        for r in sessions.stitch(df).collect():
            got.setdefault(r.session_id, set()).add(r.line_no)
        assert {frozenset(s) for s in got.values()} == greedy(rows)


def test_other_formats(spark, read, tmp_path):
    openai = {"session_id": "e", "request": {"model": "m", "messages": [user("hi")], "tools": [WEATHER]}, "response": {"created": 17, "choices": [{"message": call("get_weather", city="A")}]}}
    blocks = {
        "session_id": "a",
        "request": {"model": "c", "system": [{"text": "be"}, {"text": "kind"}], "tool_choice": {"type": "any"}, "tools": [{"name": "f", "input_schema": {"type": "object"}}, {"x": 1}], "messages": [user("q"), {"role": "assistant", "content": [{"type": "text", "text": "so"}, {"type": "tool_use", "id": "1", "name": "f", "input": {"k": 1}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "is_error": True, "content": [{"text": "bad"}]}, {"type": "text", "text": "go on"}]}]},
        "response": {"type": "message", "role": "assistant", "content": [{"type": "tool_use", "name": "f", "input": {}}]},
    }
    rows = {r.session_id: r for r in read([openai, blocks, {"response": 3}, [1]]).collect()}
    assert rows["e"].ts == "17" and rows["e"].response.tool_calls[0].name == "get_weather" and rows[None].skip_reason == "malformed"
    a = rows["a"]
    assert [(m.role, m.content) for m in a.messages] == [("system", "be kind"), ("user", "q"), ("assistant", "so"), ("tool", "Error: bad"), ("user", "go on")]
    assert a.tool_choice == "required" and [t.name for t in a.tools] == ["f"] and a.response.tool_calls[0].arguments == "{}"
    with pytest.raises(ValueError):
        logs.usable(read(["x", "y"]))


def test_telemetry(spark, tmp_path):
    def attrs(**kv):
        return [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in kv.items()]

    blob = lambda t, **more: {"traceId": t, "name": "chat", "attributes": attrs(gen_ai__prompt=json.dumps([user("hi")]), gen_ai__completion=json.dumps([text("yo")]), gen_ai__request__tools=json.dumps([WEATHER]))} | more
    spelled = {"traceId": "t3", "name": "chat", "attributes": attrs(gen_ai__prompt__0__role="user", gen_ai__prompt__0__content="hi", gen_ai__completion__0__role="assistant", gen_ai__completion__0__tool_calls__0__name="f", gen_ai__completion__0__tool_calls__0__arguments='{"a":1}', llm__request__functions__0__name="f", llm__request__functions__0__parameters='{"type":"object"}')}
    doc = {"resourceSpans": [7, {"scopeSpans": [{"spans": [blob("t1"), blob("t2"), spelled, blob("t4", status={"code": 2}), {"traceId": "t5", "name": "db", "attributes": []}]}]}]}
    (tmp_path / "spans.json").write_text(json.dumps(doc, indent=1))
    rows = logs.read_logs(spark, str(tmp_path / "spans.json"))
    assert {r.skip_reason: r["count"] for r in logs.skip_counts(rows).collect()} == {"failed_status": 1, "no_genai_attrs": 1}
    good = {r.session_id: r for r in logs.usable(rows).collect()}
    assert set(good) == {"t1", "t2", "t3"} and good["t3"].response.tool_calls[0].arguments == '{"a":1}' and good["t3"].tools[0].name == "f"
    assert all(r.tool_choice == "auto" for r in good.values())
