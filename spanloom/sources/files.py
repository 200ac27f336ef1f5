"""Small JSON files: scorecards, mined checks, curated recordings, tool definitions. One file is one document; many are read as a table."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import dumps
from ..operators.probes import check_tools
from .logs import CALL

FORMAT = 1
SCORECARD = "label string, model string, quant string, runtime string, tools_fingerprint string, engine_version string, capabilities map<string,double>, results array<struct<probe_id:string,capability:string,score:double,error:string>>, n_probes int, samples int, generated_at string, lockfile_format int, traces_fingerprint string"
CATEGORIES = ("schema_validity", "tool_selection", "no_tool")
STATUSES = ("pending", "accepted", "rejected")


def load_tools(path: str) -> list[dict]:
    return check_tools(json.loads(Path(path).read_text()))


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def scorecard(doc: Any) -> dict:
    """A scorecard from its document: a newer format or a capability that is no number raises; results are read leniently."""
    if not isinstance(doc, dict) or not isinstance(doc.get("capabilities"), dict):
        raise ValueError("a scorecard has capabilities")
    if (doc.get("lockfile_format") or FORMAT) > FORMAT:
        raise ValueError("the scorecard is of a newer format")
    if not all(map(_number, doc["capabilities"].values())):
        raise ValueError("a capability's score is a number")
    results = [{"probe_id": str(r.get("probe_id", "")), "capability": str(r.get("capability", "")), "score": float(r["score"]) if _number(r.get("score")) else 0.0, "error": r.get("error")} for r in doc.get("results") or [] if isinstance(r, dict)]
    whole = lambda k, d: doc[k] if isinstance(doc.get(k), int) and not isinstance(doc.get(k), bool) else d
    return {
        **{k: str(doc.get(k) or "") for k in ("label", "model", "quant", "runtime", "tools_fingerprint", "engine_version")}, "capabilities": {k: float(v) for k, v in doc["capabilities"].items()}, "results": results,
        "n_probes": whole("n_probes", len(results)), "samples": max(1, whole("samples", 1)), "generated_at": doc.get("generated_at"), "lockfile_format": FORMAT, "traces_fingerprint": doc.get("traces_fingerprint"),
    }


def read_scorecards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a file, with lock_id = its place in paths."""
    docs = [scorecard(json.loads(Path(p).read_text())) | {"lock_id": k} for k, p in enumerate(paths)]
    return spark.createDataFrame(docs, "lock_id int, " + SCORECARD)


def scores(cards: DataFrame) -> DataFrame:
    """(lock_id, capability, score, trials) of scorecards; trials are results times samples."""
    counted = cards.select("lock_id", "samples", F.explode("results").alias("r")).groupBy("lock_id", F.col("r.capability").alias("capability")).agg((F.count("*") * F.max("samples")).alias("trials"))
    each = cards.select("lock_id", F.explode("capabilities").alias("capability", "score"))
    return each.join(counted, ["lock_id", "capability"], "left").fillna(0, ["trials"])


def write_json(doc: dict, path: str) -> None:
    """One indented document with a line end, in a folder that is made if need be."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(doc, indent=2, ensure_ascii=False) + "\n")


def write_scorecard(card: dict, path: str) -> None:
    card = {k: v for k, v in card.items() if k != "lock_id"}
    card["results"] = [{k: v for k, v in r.items() if k != "error" or v} for r in card["results"]]
    write_json(card, path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, messages, tools, response) of a curated export. A record without an id is named by its content; ids are unique."""
    import hashlib

    doc = json.loads(Path(path).read_text())
    if not isinstance(doc, dict) or not isinstance(doc.get("records"), list):
        raise ValueError("an export has records")
    rows, seen = [], set()
    for r in doc["records"]:
        reply = r.get("response") or {}
        calls = [{"name": c.get("name") or "", "arguments": c["arguments"] if isinstance(c.get("arguments"), str) and c["arguments"] else json.dumps(c.get("arguments") or {})} for c in reply.get("tool_calls") or []]
        key = str(r["id"]) if r.get("id") is not None else hashlib.sha256(dumps(r).encode()).hexdigest()[:12]
        if key in seen:
            raise ValueError(f"more than one record is called {key}")
        seen.add(key)
        tools = [{"name": t["function"].get("name"), "description": t["function"].get("description"), "parameters": dumps(t["function"].get("parameters") or {})} for t in r.get("tools") or []]
        rows.append({"id": key, "messages": dumps(r.get("messages") or []), "tools": tools, "response": {"content": reply.get("content") or None, "tool_calls": calls}})
    return spark.createDataFrame(rows, f"id string, messages string, tools array<struct<name:string,description:string,parameters:string>>, response struct<content:string,tool_calls:array<{CALL}>>")


def save_mined(mined: DataFrame, path: str, header: dict | None = None) -> None:
    probes = []
    for r in mined.collect():  # a file for review, after sampling to a few a tool
        d = r.asDict(recursive=True)
        d |= {"messages": [*map(json.loads, d["messages"])], "tools": [*map(json.loads, d["tools"])], "reference": json.loads(d["reference"]), "provenance": {k: v for k, v in d["provenance"].items() if v is not None}}
        kind = {"tool_selection": {"type": "calls_tool", "tool": d["tool"]}, "no_tool": {"type": "no_tool_call"}}
        probes.append(d | {"check": kind.get(d["category"], {"type": "schema_valid_call"})})
    write_json({"version": 1, **(header or {}), "probes": probes}, path)


def load_mined(spark: SparkSession, path: str) -> DataFrame:
    """The mined table from its file, checked: known categories and states, one row an id and category, a tool where one is expected."""
    doc = json.loads(Path(path).read_text())
    rows, seen = [], set()
    for p in doc.get("probes") if isinstance(doc, dict) and isinstance(doc.get("probes"), list) else [None]:
        if not isinstance(p, dict) or p.get("category") not in CATEGORIES or p.get("status", "pending") not in STATUSES or not p.get("id"):
            raise ValueError("a mined row has an id, a known category and a known status")
        if (p["id"], p["category"]) in seen:
            raise ValueError(f"more than one row is called {p['id']}")
        seen.add((p["id"], p["category"]))
        if p["category"] == "tool_selection" and not p.get("tool"):
            raise ValueError(f"{p['id']} expects a tool but names none")
        v = p.get("provenance") or {}
        rows.append({"id": p["id"], "category": p["category"], "messages": [*map(dumps, p.get("messages") or [])], "tools": [*map(dumps, p.get("tools") or [])], "tool": p.get("tool"), "status": p.get("status", "pending"), "provenance": {"sessions": v.get("sessions"), "rule": v.get("rule"), "mined_at": v.get("mined_at"), "model": v.get("model"), "source": v.get("source"), "redact_patterns": v.get("redact_patterns"), "cluster": v.get("cluster"), "edited_from": v.get("edited_from")}, "sensitive": p.get("sensitive", True), "reference": dumps(p.get("reference") or {})})
    provenance = "struct<sessions:int,rule:string,mined_at:string,model:string,source:string,redact_patterns:array<string>,cluster:string,edited_from:string>"
    return spark.createDataFrame(rows, f"id string, category string, messages array<string>, tools array<string>, tool string, status string, provenance {provenance}, sensitive boolean, reference string")
