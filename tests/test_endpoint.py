import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import PythonException

from spanloom import __main__ as cli
from spanloom.functions import text as T
from spanloom.sources import endpoint, logs
from tests.test_cli import folder  # noqa: F401
from tests.test_mining import sample_log


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        code, reply = 200, {}
        if self.path.endswith("/embeddings"):
            rows = [{"index": k, "embedding": [1.0, float(len(t) % 2)]} for k, t in enumerate(body["input"])]
            reply = {"data": rows[::-1]}
        elif body["model"] == "absent":
            code = 404
        elif "sum" in json.dumps(body["messages"]) or "seven" in json.dumps(body["messages"]):
            code, reply = 500, {"error": "boom key-1"}
        else:
            calls = [{"function": {"name": t["function"]["name"], "arguments": "{}"}} for t in body.get("tools", [])[:1]]
            reply = {"choices": [{"message": {"role": "assistant", "content": "", "reasoning": "<think>hm</think> YES", "tool_calls": calls}}]}
        data = json.dumps(reply).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


PROBE = "id string, messages string, tools array<struct<name:string,description:string,parameters:string>>, response_format string"


def test_answers(spark, url):
    rows = [("a", '[{"role": "user", "content": "x"}]', [("f", "d", "{}")], None), ("b", '[{"role": "user", "content": "sum"}]', [], '{"type": "json_object"}')]
    got = {r.id: r for r in endpoint.answers(spark.createDataFrame(rows, PROBE), url, "m", "key-1").collect()}
    assert got["a"].response.content == "YES" and got["a"].response.tool_calls[0].name == "f" and got["a"].error is None
    assert got["b"].error.startswith("500") and "key-1" not in got["b"].error
    with pytest.raises(PythonException, match="404"):
        endpoint.answers(spark.createDataFrame(rows, PROBE), url, "absent").collect()


def test_embeddings_keep_their_order(spark, url):
    contexts = spark.createDataFrame([(str(k), "x" * k) for k in range(150)], "context_key string, text string")
    got = {r.context_key: r.vec for r in endpoint.embeddings(contexts, url, "e").collect()}
    assert got == {str(k): [1.0, float(k % 2)] for k in range(150)}
    for bad in ([], {"data": []}, {"data": [[1.0]]}):
        with pytest.raises(ValueError):
            endpoint.vectors_of(bad, 1)


def test_probe_cluster_and_doctor(spark, folder, url, capsys):  # noqa: F811
    run = lambda *a: cli.run(spark, [str(x) for x in a])
    card = folder / "live.card"
    assert run("probe", "--tools", folder / "tools.json", "--endpoint", url, "--model", "m", "--samples", 2, "--out", card) == 0
    doc = json.loads(card.read_text())
    assert doc["samples"] == 2 and any(r.get("error", "").startswith("500") for r in doc["results"]) and doc["traces_fingerprint"] is None
    assert run("diff", card, card, "--format", "table") == 0
    assert "failed as requests" in capsys.readouterr().out
    assert run("ingest", folder / "log.jsonl", "--out", folder / "m.json", "--cluster", "embeddings", "--embed-endpoint", url) == 0
    near = json.loads((folder / "m.json").read_text())
    assert all("check" in p for p in near["probes"])
    assert run("ingest", folder / "log.jsonl", "--out", folder / "n.json", "--cluster", "embeddings", "--embed-endpoint", "http://127.0.0.1:9") == 0
    assert "equal contexts make the clusters" in capsys.readouterr().err
    tool = {"type": "function", "function": {"name": "gone", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}}}}
    records = [{"id": "1", "messages": [], "tools": [tool], "response": {"content": '{"a": 1}'}}, {"id": "2", "messages": [], "tools": [tool], "response": {"tool_calls": [{"name": "gone", "arguments": "{}"}]}}, {"id": "3", "messages": [], "tools": [tool], "response": {"content": "words"}}]
    (folder / "t.json").write_text(json.dumps({"version": 1, "records": records}))
    assert run("doctor", "--tools", folder / "tools.json", "--traces", folder / "t.json") == 1
    assert "gone is gone, but 2 checks" in capsys.readouterr().out
    assert run("probe", "--tools", folder / "tools.json", "--simulate", folder / "q8.json", "--traces", folder / "t.json", "--out", folder / "traced.card") == 0
    assert json.loads((folder / "traced.card").read_text())["traces_fingerprint"]
    with pytest.raises(ValueError):
        run("probe", "--tools", folder / "tools.json")


def test_files_of_any_shape_and_folders(spark, tmp_path):
    span = {"traceId": "t", "name": "c", "attributes": {"gen_ai.prompt": json.dumps([{"role": "user", "content": "hi"}])}}
    (tmp_path / "a.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span] * 3}]}]}, indent=2))
    (tmp_path / "b.jsonl").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}) + "\n" + "\n".join(map(json.dumps, sample_log())))
    (tmp_path / "_hidden").write_text("x")
    rows = logs.read_logs(spark, str(tmp_path)).select("source_file", "file_ord", "line_no", "session_id", "skip_reason").collect()
    assert sum(r.source_file == "a.json" for r in rows) == 3 and len(rows) == 4 + len(sample_log())
    own = sorted((r.line_no for r in rows if r.source_file == "b.jsonl"))
    assert own == [*range(1 + len(sample_log()))] and {r.file_ord for r in rows} == {0, 1}
    assert logs.is_document('{\n  "resourceSpans": [') and not logs.is_document('{"spans": []}\n{') and not logs.is_document("{\n")
    with pytest.raises(FileNotFoundError):
        logs.read_logs(spark, str(tmp_path / "none"))


def test_redaction_beyond_ascii(spark):
    from pyspark.sql import functions as F

    rows = ["josé@exámple.com, zoë@mail.com", "/home/josé/secret/plan.txt", "call ٠١٢٣٤٥٦٧٨ or +49\u00a0151\u2003234567", "C:\\Büro\\Pläne\\x.txt", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").orderBy("k").select(T.scrub(F.col("t"), ["emails", "phones", "paths"])).collect()]
    assert got == ["<email>, <email>", "<path>", "call <phone> or <phone>", "<path>", "nothing"]
    import re

    for text, want in zip(rows, got):
        for name in ("emails", "phones", "paths"):
            text = re.sub(T.for_python(T.PATTERNS[name]), f"<{name[:-1]}>", text)
        assert text == want
    spaced = "a\u00a0\u2003b \x0b\x1cc\u3000\x85 2024-01-02T03:04:05+02:00 é2024-01-02 2024-01-02."
    got = spark.createDataFrame([(spaced,)], "t string").select(T.norm_text(F.col("t"))).first()[0]
    assert got == T.norm_value(spaced) == "a b c <ts> é2024-01-02 <ts>."
    import pandas as pd  # noqa: F401

    args = spark.createDataFrame([('{"b": ["x  2024-01-02"], "a": 1}', "not\u00a0 json")], "a string, b string").select(T.norm_args(F.col("a")), T.norm_args(F.col("b"))).first()
    assert tuple(args) == ('{"a":1,"b":["x <ts>"]}', "not json")
