import json

from pyspark.sql import functions as F

from spanloom.operators import sessions
from spanloom.plans.base import exchanges
from spanloom.streaming import live

SF = "/root/testdata/sf0.001"


def test_assignment():
    state: dict = {}
    a = live.assign(state, "1", 0, ["u"], "r", "q1")
    assert live.assign(state, "2", 10, ["u", "r", "v"], "s", "q2") == a
    assert live.assign(state, "3", 299, ["u"], "r", "q1") == a  # the same request again
    assert live.assign(state, "4", 301, ["u"], "r", "q1") != a  # too long after the first
    assert live.assign(state, "5", 302, ["u", "r", "v", "s", "w"], "t", "q3") == a
    assert live.assign(state, "6", 303, ["u", "other"], "t", "q4") not in (a, None)
    assert live.assign({}, "7", 0, ["u", "r", "v"], "s", "q2") != a


def test_stream_agrees_with_the_batch(spark):
    from spanloom.plans.streams import stream_sessions

    got = {r.rec_id: r.first_rec for r in stream_sessions(spark, SF).collect()}
    batch = sessions.stitch(exchanges(spark, SF, labelled=False)).select(F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lpad(F.col("at").cast("string"), 4, "0")).alias("rec_id"), "session_id").collect()
    assert len(got) == len(batch) > 0
    assert len(set(got.values())) == len({r.session_id for r in batch})
    assert len({(got[r.rec_id], r.session_id) for r in batch}) == len(set(got.values()))


def body(*events):
    return "".join(f"data: {e if isinstance(e, str) else json.dumps(e)}\n\n" for e in events)


def delta(index=0, **d):
    return {"choices": [{"index": index, "delta": d}]}


def test_event_streams(spark):
    b = body(delta(content="Hel"), delta(1, content="no"), "{broken", delta(content="lo"), delta(tool_calls=[{"index": 1, "id": "b", "function": {"name": "g", "arguments": "{"}}]), delta(tool_calls=[{"index": 0, "id": "a", "function": {"name": "f", "arguments": ""}}, {"index": 1, "function": {"arguments": "}"}}]), "[DONE]")
    assert live.assemble(b) == {"content": "Hello", "tool_calls": [{"id": "a", "name": "f", "arguments": ""}, {"id": "b", "name": "g", "arguments": "{}"}]}
    assert live.assemble("") is None and live.assemble(body("[DONE]")) is None
    rows = spark.createDataFrame([(b,), (body(delta(role="assistant")),), ("",)], "body string")
    got = rows.select(live.content_of(F.col("body")).alias("c"), live.assembled(F.col("body")).alias("m")).collect()
    assert [r.c for r in got] == ["Hello", None, None] and got[0].m.tool_calls[1].arguments == "{}"
    status = spark.createDataFrame([(200, True, False), (200, False, False), (200, False, True), (500, False, False)], "s int, done boolean, gone boolean")
    assert [r[0] for r in status.select(live.capture_status(F.col("s"), F.col("done"), F.col("gone"))).collect()] == [200, 502, 499, 500]


def test_tailing_segments(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    record = {"session_id": "s", "request": {"messages": [{"role": "user", "content": "hi"}]}, "response": {"message": {"role": "assistant", "content": "yo"}}}
    (folder / "1.jsonl").write_text(json.dumps(record) + "\n{bad\n")
    (folder / "2.jsonl").write_text(json.dumps(record | {"meta": {"status": 503}}) + "\n")
    rows = live.tail_logs(spark, str(folder)).select("session_id", "skip_reason")
    run = live.write_segments(rows, str(tmp_path / "out"), str(tmp_path / "state"), 1)
    run.awaitTermination(60)
    got = spark.read.schema("session_id string, skip_reason string").json(str(tmp_path / "out"))
    assert {(r.session_id, r.skip_reason) for r in got.collect()} == {("s", None), ("s", "failed_status"), (None, "malformed")}
