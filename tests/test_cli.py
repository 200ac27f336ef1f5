import json

import pytest

from spanloom import __main__ as cli
from spanloom import report
from tests.test_mining import sample_log
from tests.test_scoring import TOOLS


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "tools.json").write_text(json.dumps(TOOLS))
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, sample_log())))
    for name, rate in (("q8", 1.0), ("q4", 0.34)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"label": name, "model": f"m-1-{name}", "quant": name, "runtime": "x", "capabilities": {"tool_selection": rate, "structured_output": rate}}))
    return tmp_path


def test_from_tools_to_gate(spark, folder, capsys):
    run = lambda *a: cli.run(spark, [str(x) for x in a])
    assert run("derive", "--tools", folder / "tools.json") == 0
    assert len(capsys.readouterr().out.splitlines()) == 32
    for q in ("q8", "q4"):
        assert run("probe", "--tools", folder / "tools.json", "--simulate", folder / f"{q}.json", "--out", folder / f"{q}.card") == 0
    a, b = folder / "q8.card", folder / "q4.card"
    assert run("gate", "-b", a, "-c", a) == 0 and run("gate", "-b", a, "-c", b) == 1
    assert run("gate", "-b", a, "-c", b, "--confidence", 0.95) == 1 and run("gate", "-b", a, "-c", b, "--confidence", 0.99) == 0  # z is 1.73
    assert run("gate", "-b", a, "-c", b, "--require-same-model") == 1  # m-1 both
    capsys.readouterr()
    assert run("diff", a, b, "--format", "json") == 0
    got = json.loads(capsys.readouterr().out)
    assert got["regressed"] and {r["capability"]: r["candidate"] for r in got["rows"]}["tool_selection"] == 0.3333
    assert run("trend", a, b, a) == 0 and "unstable" in capsys.readouterr().out
    with pytest.raises(ValueError):
        run("diff", a, b, "--confidence", 2)


def test_ingest_and_review(spark, folder, capsys):
    run = lambda *a: cli.run(spark, [str(x) for x in a])
    assert run("ingest", folder / "log.jsonl", "--out", folder / "mined.json") == 0
    assert "skipped failed_status: 1" in capsys.readouterr().out
    assert run("review", folder / "mined.json") == 0 and "accepted" in capsys.readouterr().out
    assert run("doctor", "--tools", folder / "tools.json") == 0
    assert run("doctor", "--tools", folder / "tools.json", "--mined", folder / "mined.json") == 1  # its tools are gone
    (folder / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        run("derive", "--tools", folder / "bad.json")


def test_reports():
    rows = [{"capability": "<b>", "baseline": 1.0, "candidate": None, "delta": None, "significant": None, "status": "removed"}]
    assert "| <b> | 1.00 | — | — | removed |" in report.render_diff(rows) and "&lt;b&gt;" in report.render_diff(rows, "html")
    ladder = [{"capability": "c", "values": [0.0, None, 1.0], "delta": 1.0, "worst_step": 1.0, "monotonic": True, "status": "improved"}]
    assert "▁ █" in report.render_trend(ladder, ["a", "b", "c"]) and report.render_findings([]) == "no findings\n"
