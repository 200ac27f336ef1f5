"""Answers and embeddings from a chat-completions endpoint. Executors ask, each task for its own rows; nothing passes through the driver.

A request that fails is the row's error; one that says that none can succeed (no such model, no access, no such address) stops the run.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.shipping import ship
from .logs import CALL, _response

FATAL = (401, 403, 404)
TIMEOUT = 60.0


class Fatal(RuntimeError):
    """No request to this endpoint can succeed."""


def _post(url: str, body: dict, key: str, timeout: float) -> Any:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), head, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read())
    except urllib.error.HTTPError as e:
        said = e.read().decode(errors="replace")[:500]
        said = said.replace(key, "[REDACTED]") if key else said
        raise (Fatal if e.code in FATAL else RuntimeError)(f"{e.code}: {said}") from None


def message_of(reply: Any) -> tuple[str | None, list[tuple[str, str]]]:
    """(text, calls) of a completion; where the text is empty the reasoning stands in, and a leading think block goes."""
    import re

    message = reply["choices"][0]["message"]
    said, calls = _response(message)
    if not said:
        said = next((message[k] for k in ("reasoning", "reasoning_content") if isinstance(message.get(k), str) and message[k]), None)
    return (re.sub(r"(?is)^\s*<think>.*?</think>\s*", "", said) if said else said), calls


def answers(probes: DataFrame, url: str, model: str, key: str = "", temperature: float = 0.0, timeout: float = TIMEOUT) -> DataFrame:
    """(id, response, error) of probes (id, messages, tools, response_format): JSON texts, and tools as (name, description, parameters)."""
    ship(probes.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"id string, response struct<content:string,tool_calls:array<{CALL}>>, error string"
    arrow = to_arrow_schema(probes.sparkSession.createDataFrame([], schema).schema)

    def ask(row: dict) -> dict:
        body = {"model": model, "temperature": temperature, "messages": json.loads(row["messages"])}
        if row["tools"]:
            body["tools"] = [{"type": "function", "function": {"name": t["name"], "description": t["description"], "parameters": json.loads(t["parameters"])}} for t in row["tools"]]
        if row["response_format"]:
            body["response_format"] = json.loads(row["response_format"])
        try:
            said, calls = message_of(_post(f"{url.rstrip('/')}/chat/completions", body, key, timeout))
        except Fatal:
            raise
        except (RuntimeError, OSError, ValueError, KeyError, IndexError, TypeError) as e:
            return {"id": row["id"], "response": {"content": None, "tool_calls": []}, "error": str(e) or type(e).__name__}
        return {"id": row["id"], "response": {"content": said, "tool_calls": [{"name": n, "arguments": a} for n, a in calls]}, "error": None}

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([*map(ask, batch.to_pylist())], schema=arrow)

    return probes.select("id", "messages", "tools", "response_format").mapInArrow(run, schema)


def vectors_of(reply: Any, n: int) -> list[list[float]]:
    """The vectors of an embeddings reply in the order of what was sent, which each row's index says."""
    rows = reply.get("data") if isinstance(reply, dict) else None
    if not isinstance(rows, list) or len(rows) != n or not all(isinstance(r, dict) and isinstance(r.get("embedding"), list) for r in rows):
        raise ValueError(f"no {n} embeddings came back")
    place = lambda r: r["index"] if isinstance(r.get("index"), int) else 0
    return [[float(x) for x in r["embedding"]] for r in sorted(rows, key=place)]


def embeddings(contexts: DataFrame, url: str, model: str, key: str = "", batch: int = 64, timeout: float = 120.0) -> DataFrame:
    """(context_key, vec) of contexts (context_key, text), so many texts a request."""
    ship(contexts.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = vectors_of(_post(f"{url.rstrip('/')}/embeddings", {"model": model, "input": part.column(1).to_pylist()}, key, timeout), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.float64()))], ["context_key", "vec"])

    return contexts.select("context_key", "text").mapInArrow(run, "context_key string, vec array<double>")
