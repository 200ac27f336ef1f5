"""Live traffic: tailing log segments, session ids as records arrive, reassembly of event streams, and a rotated sink."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.shipping import ship
from ..sources.logs import parse_text

RETRY_SECONDS, STATE_SECONDS = 300, 86_400


def tail_logs(spark: SparkSession, folder: str, fmt: str = "auto", files_a_trigger: int = 100) -> DataFrame:
    """Exchanges of a folder of JSONL segments, as they are added."""
    text = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder)
    lines = text.select(F.col("_metadata.file_name").alias("source_file"), F.lit(0).alias("file_ord"), F.col("_metadata.file_block_start").alias("line_no"), "value")
    return parse_text(lines, fmt, number=True)


def write_segments(df: DataFrame, folder: str, checkpoint: str, records_a_file: int = 100_000, **trigger):
    """Append records to JSONL segments of bounded length."""
    return df.writeStream.format("json").option("maxRecordsPerFile", records_a_file).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start(folder)


def write_updates(grouped: DataFrame, folder: str, checkpoint: str, **trigger):
    """The groups that each batch changed, as Parquet under the batch's number. Nothing is gathered, and a repeated batch overwrites itself."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return grouped.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_updates(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The last state of each group that write_updates() has written."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")


# --- session ids ---


def _chain(parts: list[str]) -> list[str]:
    out, last = [], ""
    for p in parts:
        last = hashlib.md5((last + hashlib.md5(p.encode()).hexdigest()).encode()).hexdigest()
        out.append(last)
    return out


def assign(state: dict, rec_id: str, at: float, norm: list[str], reply: str, request: str, retry_seconds: float = RETRY_SECONDS, state_seconds: float = STATE_SECONDS) -> str:
    """The session of a record, given what the first message's key has seen; state is changed.

    state["said"]: the transcript after each answer -> [session, when]; state["asked"]: each raw request -> [session, first seen]. A repeated
    request within retry_seconds of the first, not of the last, belongs to the same session; otherwise the longest proper prefix of the
    request that is a known transcript decides; otherwise a session begins.
    """
    said, asked = state.setdefault("said", {}), state.setdefault("asked", {})
    for kept, limit in ((said, state_seconds), (asked, retry_seconds)):
        for k in [k for k, (_, when) in kept.items() if at - when > limit]:
            del kept[k]
    keys = _chain(norm)
    if request in asked:
        sid = asked[request][0]
    else:
        sid = next((said[k][0] for k in reversed(keys[:-1]) if k in said), None) or f"live:{hashlib.md5(rec_id.encode()).hexdigest()[:12]}"
        asked[request] = [sid, at]
    said[_chain([*norm, reply])[-1]] = [sid, at]
    return sid


def follow(state: dict, rec_id: str, at: float, norm: list[str], state_seconds: float = STATE_SECONDS) -> str:
    """The session of a record by the rule of sessions.stitch(): equal requests are one, the first to go on with a request stays in its session, any
    other branches off. state["nodes"]: each request -> [session, when, gone on with]."""
    nodes, keys = state.setdefault("nodes", {}), _chain(norm) or [""]
    known = lambda k: k in nodes and at - nodes[k][1] <= state_seconds
    if known(keys[-1]):
        nodes[keys[-1]][1] = at
        return nodes[keys[-1]][0]
    before = next((nodes[k] for k in reversed(keys[:-1]) if known(k)), None)
    if before is None or before[2]:
        sid = f"live:{hashlib.md5(rec_id.encode()).hexdigest()[:12]}"
    else:
        sid, before[1], before[2] = before[0], at, True
    nodes[keys[-1]] = [sid, at, False]
    return sid


def live_sessions(records: DataFrame, retry_seconds: float = RETRY_SECONDS, state_seconds: float = STATE_SECONDS, late: str = "1 hour", branches: bool = False) -> DataFrame:
    """(rec_id, session_id) of a stream (rec_id, at timestamp, norm array<string>, reply, request).

    branches: sessions branch as those of sessions.stitch() do, by follow(), for records that arrive shorter requests first; answers and raw requests
    count for nothing. A system prompt that was sent alone can then be gone on with by any talk that has it, so state is kept by the first message.

    State is kept by the first message, or by the first two where the first is a system prompt, which all of an application's talks may share: every
    usable prefix has them. (A request of a system prompt alone is kept by it and its answer.) State expires by event time, behind a watermark of
    `late`: a limit on the number of entries would be a limit a key.
    """
    ship(records.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat([*frames]).sort_values(["at", "rec_id"], kind="stable")
        if branches:
            out = [(r.rec_id, follow(known, r.rec_id, r.at.timestamp(), [*r.norm], state_seconds)) for r in rows.itertuples()]
            last = rows["at"].max().timestamp()
            known = {"nodes": {k: v for k, v in known["nodes"].items() if last - v[1] <= state_seconds}}
        else:
            out = [(r.rec_id, assign(known, r.rec_id, r.at.timestamp(), [*r.norm], r.reply, r.request, retry_seconds, state_seconds)) for r in rows.itertuples()]
        state.update((json.dumps(known),))
        until = max(rows["at"].max().timestamp() * 1000, state.getCurrentWatermarkMs()) + state_seconds * 1000
        state.setTimeoutTimestamp(int(until))
        yield pd.DataFrame(out, columns=["rec_id", "session_id"])

    first = F.coalesce(F.get("norm", F.lit(0)), F.lit(""))
    prompt = first.startswith("system:") | first.rlike('"role": ?"(system|developer)"')
    start = F.when(F.lit(not branches) & prompt, F.concat_ws("\x1e", first, F.coalesce(F.get("norm", F.lit(1)), "reply"))).otherwise(first)
    keyed = records.withWatermark("at", late).withColumn("__key", F.md5(start))
    return keyed.groupBy("__key").applyInPandasWithState(step, "rec_id string, session_id string", "known string", "append", GroupStateTimeout.EventTimeTimeout)


# --- event streams ---


def data_events(body: Column) -> Column:
    """The payloads of a server-sent body, without the terminator."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.rtrim(F.replace(x, F.lit("\r"), F.lit(""))))
    payloads = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substr(x, F.lit(6))))
    return F.filter(payloads, lambda x: (x != "[DONE]") & (x != ""))


def content_of(body: Column) -> Column:
    """The text of choice 0 of a streamed answer, put together from its deltas; null where no delta has text."""
    events = F.transform(data_events(body), lambda e: F.try_variant_get(F.try_parse_json(e), "$.choices", "array<variant>"))
    first = F.transform(events, lambda c: F.get(F.filter(c, lambda x: F.coalesce(F.try_variant_get(x, "$.index", "int"), F.lit(0)) == 0), F.lit(0)))
    texts = F.filter(F.transform(first, lambda c: F.try_variant_get(c, "$.delta.content", "string")), lambda t: t.isNotNull())
    return F.when(F.size(texts) > 0, F.array_join(texts, ""))


def assemble(body: str | None) -> dict | None:
    """The message of a streamed answer: choice 0's text and tool calls, pieced together a slot at a time; None where nothing came."""
    text, slots, came = "", {}, False
    for line in (body or "").splitlines():
        if not line.startswith("data:"):
            continue
        try:
            event = json.loads(line[5:].strip())
        except ValueError:
            continue
        for choice in event.get("choices") or [] if isinstance(event, dict) else []:
            delta = choice.get("delta") if isinstance(choice, dict) and choice.get("index", 0) == 0 else None
            if not isinstance(delta, dict):
                continue
            came = True
            text += delta["content"] if isinstance(delta.get("content"), str) else ""
            for call in delta.get("tool_calls") or []:
                key = call.get("index") if call.get("index") is not None else call.get("id") or 0
                slot = slots.setdefault(key, {"id": "", "name": "", "arguments": ""})
                f = call.get("function") or {}
                slot["id"] = call.get("id") or slot["id"]
                slot["name"] += f.get("name") or ""
                slot["arguments"] += f.get("arguments") or ""
    if not came:
        return None
    order = sorted((k for k in slots if isinstance(k, int))) + [k for k in slots if not isinstance(k, int)]
    return {"content": text or None, "tool_calls": [slots[k] for k in order]}


def assembled(body: Column) -> Column:
    """assemble() over a column, in Arrow batches."""

    @F.pandas_udf("content string, tool_calls array<struct<id:string,name:string,arguments:string>>")
    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([assemble(b) or {"content": None, "tool_calls": None} for b in bodies], columns=["content", "tool_calls"])

    return run(body)


def capture_status(status: Column, finished: Column, client_gone: Column) -> Column:
    """499 where the client went, 502 where the stream broke off; such records are never mined."""
    return F.when(client_gone, 499).when((status < 400) & ~finished, 502).otherwise(status)
