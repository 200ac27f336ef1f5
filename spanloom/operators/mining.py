"""Mining replayable checks from sessions: cluster, infer what can be trusted, sample, redact, freeze."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as S
from ..functions import text as T
from ..functions.shipping import ship
from ..sources.logs import landed
from . import sessions


@dataclass(frozen=True)
class Config:
    min_agreement: int = 2
    min_agreement_notool: int = 3
    per_capability: int = 8
    max_context_tokens: int = 8192
    redact_patterns: tuple[str, ...] = ()
    cluster: str = "hash"


def toolset(tools: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(tools, lambda t: t["norm"]), ","), F.lit("]"))


def context_key(norm: Column, tools: Column) -> Column:
    return T.hash_text(F.concat(F.to_json(norm), toolset(tools)))


def context_tokens(messages: Column, tools: Column) -> Column:
    """A quarter of the length of messages and tools as spaced JSON. raw has no blanks, so a blank is counted for each comma and colon outside strings."""
    bare = lambda raw: F.regexp_replace(F.regexp_replace(raw, r"\\.", ""), '"[^"]*"', "")
    spaced = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x["raw"], F.regexp_replace(bare(x["raw"]), "[^,:]", ""))), ", ")
    return T.estimated_tokens(F.concat(F.lit('{"messages": ['), spaced(messages), F.lit('], "tools": ['), spaced(tools), F.lit("]}")))


def filter_mineable(rows: DataFrame, config: Config) -> DataFrame:
    """rows with skip_reason: forced choices say nothing about the model, and contexts beyond the cap cost too much to replay."""
    forced = F.coalesce(F.col("tool_choice") != "auto", F.lit(False))
    return rows.withColumn("skip_reason", F.when(forced, "forced_tool_choice").when(context_tokens(F.col("messages"), F.col("tools")) > config.max_context_tokens, "over_token_cap"))


def members(mineable: DataFrame, key: str = "context_key") -> DataFrame:
    """What each exchange says for its cluster."""
    name = F.get("response.tool_calls", F.lit(0))["name"]
    caller = F.size("response.tool_calls") > 0
    return mineable.select(
        F.col(key).alias("cluster"), "session_id", "turn", "file_ord", "line_no", "confirmed", "reasked", F.size("norm").alias("n_messages"), F.size("tools").alias("n_tools"), toolset(F.col("tools")).alias("toolset"),
        T.overlap(sessions.last_user(F.col("messages")), F.array_join(F.transform("tools", lambda t: F.concat_ws(" ", t["name"], t["description"])), " ")).alias("overlap"),
        caller.alias("caller"), (~caller & F.col("response.content").isNotNull()).alias("texter"), name.alias("name"),
        (caller & F.exists("tools", lambda t: F.coalesce(t["name"] == name, F.lit(False)))).alias("valid"),
    )


def candidates(m: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """((category, session_id, turn, ..., tool, rule, sessions), (reason, count)) of the clusters of members()."""
    order = F.struct(F.coalesce("session_id", F.lit("")).alias("s"), "turn", "line_no", "file_ord")
    pick = F.struct("session_id", "turn", "file_ord", "line_no", "n_messages", "toolset", "overlap", "name", "n_tools")
    some = lambda c, x: F.when(c, x)
    each = m.withColumn("o", order).withColumn("p", pick)
    by = each.groupBy("cluster").agg(
        F.count_if("caller").alias("callers"), F.count_if("valid").alias("valids"), F.min_by("p", "o").alias("rep"),
        F.min_by("p", some(F.col("valid"), F.col("o"))).alias("rep_valid"), F.count_distinct(some(F.col("valid"), F.col("session_id"))).alias("n_valid"),
        F.min_by("p", some(F.col("valid") & F.col("confirmed"), F.col("o"))).alias("rep_confirmed"), F.count_if(F.col("valid") & F.col("confirmed")).alias("n_confirmed"),
        F.count_distinct(some(F.col("texter"), F.col("session_id"))).alias("n_texter"), F.bool_or(F.col("texter") & F.col("reasked")).alias("again"),
    )
    named = each.where("valid").groupBy("cluster", "name").agg(F.count_distinct("session_id").alias("n"), F.min_by("p", "o").alias("p"))
    agreed = named.groupBy("cluster").agg(F.count_if(F.col("n") >= config.min_agreement).alias("n_agreeing"), F.max_by("p", F.when(F.col("n") >= config.min_agreement, F.col("n"))).alias("rep_agreed"), F.max(F.when(F.col("n") >= config.min_agreement, F.col("n"))).alias("n_agreed"), F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("by_name"))
    by = landed(by.join(agreed, "cluster", "left"))
    confirmed, called = F.col("n_confirmed") > 0, F.col("valids") > 0
    one = F.coalesce(F.col("n_agreeing") == 1, F.lit(False))

    def rows(where: Column, category: str, p: str, tool: Column, rule: str, n: Column) -> DataFrame:
        return by.where(where).select(F.lit(category).alias("category"), f"{p}.*", tool.alias("tool"), F.lit(rule).alias("rule"), n.cast("int").alias("sessions"))

    quiet = (F.col("callers") == 0) & (F.col("rep.n_tools") > 0) & (F.col("n_texter") >= config.min_agreement_notool) & ~F.col("again")
    found = [
        rows(called, "schema_validity", "rep_valid", F.col("rep_valid.name"), "schema-validity", F.col("n_valid")),
        rows(called & confirmed, "tool_selection", "rep_confirmed", F.col("rep_confirmed.name"), "continuation", F.element_at("by_name", F.col("rep_confirmed.name"))),
        rows(called & ~confirmed & one, "tool_selection", "rep_agreed", F.col("rep_agreed.name"), "min-agreement", F.col("n_agreed")),
        rows(quiet, "no_tool", "rep", F.lit(None).cast("string"), "min-agreement-notool", F.col("n_texter")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    why = F.when((F.col("callers") > 0) & ~called, "called_tool_not_offered").when(called & ~confirmed & (F.col("n_agreeing") > 1), "ambiguous_tool_selection").when(called & ~confirmed & ~one, "unconfirmed_tool_clusters")
    return out.withColumn("overlap", F.when(F.col("category") == "no_tool", F.col("overlap")).otherwise(F.lit(0.0))), by.select(why.alias("reason")).where("reason IS NOT NULL").groupBy("reason").count()


def sample(found: DataFrame, per_capability: int = 8) -> DataFrame:
    """The first of each (tool or toolset, category): clearest, then longest context, then latest turn."""
    group = F.coalesce("tool", T.hash_text(F.col("toolset"), 8))
    order = Window.partitionBy("__group", "category").orderBy("overlap", F.desc("n_messages"), F.desc("turn"), F.coalesce("session_id", F.lit("")), "line_no", "file_ord")
    return found.withColumn("__group", group).withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= per_capability).drop("__group", "__nth")


def mined_id(session_id: Column, turn: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(session_id, F.lit("")), "^sha256:", "")
    short = F.when((F.length(bare) > 16) & bare.rlike("^[0-9a-f]+$"), F.substring(bare, 1, 12)).otherwise(bare)
    return F.concat(F.lit("trace:"), short, F.lit(":t"), turn.cast("string"))


def with_suffix(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The n-th row with an id and category gets n - 1 plus signs."""
    nth = F.row_number().over(Window.partitionBy("id", "category").orderBy(*order))
    return rows.withColumn("id", F.concat("id", F.repeat(F.lit("+"), nth - 1)))


def _redacted(messages: list[str], tools: list[str], patterns: list[tuple[str, str]]) -> list[str]:
    import re

    params: dict[str, dict] = {}
    for raw in tools:
        f = json.loads(raw)["function"]
        params.setdefault(f.get("name"), f["parameters"] if isinstance(f.get("parameters"), dict) else {})

    def scrub(x):
        if isinstance(x, str):
            for name, p in patterns:
                x = re.sub(p, f"<{name}>", x)
            return x
        if isinstance(x, dict):
            return {k: scrub(v) for k, v in x.items()}
        return [*map(scrub, x)] if isinstance(x, list) else x

    out = []
    for raw in messages:
        m = json.loads(raw)
        if isinstance(m, dict):
            for call in m.get("tool_calls") or []:
                if isinstance(call, dict):
                    f = call["function"] if isinstance(call.get("function"), dict) else call
                    args = f.get("arguments")
                    if isinstance(args, str):
                        try:
                            args = json.loads(args)
                        except json.JSONDecodeError:
                            args = None
                    f["arguments"] = "{}" if args is None else json.dumps(S.redact_args(args, params.get(f.get("name") or "")) if isinstance(args, dict) else S.redact(args, None))
            if patterns and "content" in m:
                m["content"] = scrub(m["content"])
        out.append(S.dumps(m))
    return out


def _reference(category: str, calls: list, tools: list[str]) -> str:
    if category == "no_tool":
        return S.dumps({"content": "(text, no call)"})
    if not len(calls):
        return "{}"
    name = calls[0]["name"]
    schema = next((f["parameters"] if isinstance(f.get("parameters"), dict) else {} for f in (json.loads(t)["function"] for t in tools) if f.get("name") == name), None)
    try:
        args = json.loads(calls[0]["arguments"])
    except json.JSONDecodeError:
        args = {}
    args = S.redact_args(args if isinstance(args, dict) else {}, schema)
    return S.dumps({"tool": name, "valid_args": args if S.check(args, schema or {}) else S.synth_args(schema or {})})


def freeze(sampled: DataFrame, stitched: DataFrame, config: Config, source: Column, mined_at: Column) -> DataFrame:
    """The mined table. Arguments in the context are always redacted; content only by patterns, without which a row is sensitive."""
    ship(sampled.sparkSession)
    patterns = [(n[:-1], T.for_python(T.PATTERNS[n])) for n in config.redact_patterns]

    @F.pandas_udf("struct<messages:array<string>,reference:string>")
    def redacted(category: pd.Series, messages: pd.Series, tools: pd.Series, calls: pd.Series) -> pd.DataFrame:
        rows = [(_redacted(m, t, patterns), _reference(c, k, t)) for c, m, t, k in zip(category, messages, tools, calls)]
        return pd.DataFrame(rows, columns=["messages", "reference"])

    full = sampled.join(stitched.select("session_id", "turn", "messages", "tools", "response", "model"), ["session_id", "turn"])
    raw = lambda c: F.transform(c, lambda x: x["raw"])
    full = full.withColumn("r", redacted("category", raw("messages"), raw("tools"), F.col("response.tool_calls"))).withColumn("id", mined_id(F.col("session_id"), F.col("turn")))
    full = with_suffix(full, [F.col("overlap"), F.desc("n_messages"), F.desc("turn"), F.col("session_id"), F.col("line_no"), F.col("file_ord"), F.col("tool")])
    keep = F.array(*[F.lit(p) for p in config.redact_patterns]).cast("array<string>") if config.redact_patterns else F.lit(None).cast("array<string>")
    provenance = F.struct("sessions", "rule", mined_at.alias("mined_at"), "model", source.alias("source"), keep.alias("redact_patterns"), F.lit(None if config.cluster == "hash" else config.cluster).cast("string").alias("cluster"))
    return full.select("id", "category", F.col("r.messages").alias("messages"), raw("tools").alias("tools"), "tool", F.lit("pending").alias("status"), provenance.alias("provenance"), F.lit(not config.redact_patterns).alias("sensitive"), F.col("r.reference").alias("reference")).orderBy("category", "id")


def mine(exchanges: DataFrame, config: Config = Config(), clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mined, (counter, name, count)) from usable exchanges.

    Sessions are built from all of them, so that what is too long or forced is still evidence. clusters, (context_key, cluster), replaces the
    exact clusters where near ones have been found.
    """
    unknown = set(config.redact_patterns) - set(T.PATTERNS)
    if unknown:
        raise ValueError(f"unknown redact pattern: {', '.join(sorted(unknown))}")
    rows = exchanges.withColumn("norm", F.transform("messages", lambda m: m["norm"]))
    marked = landed(filter_mineable(sessions.with_evidence(sessions.stitch(rows)), config).withColumn("context_key", context_key(F.col("norm"), F.col("tools"))))
    stitched = marked.drop("skip_reason", "context_key")
    good = marked.where("skip_reason IS NULL")
    if clusters is not None:
        good = good.join(clusters, "context_key", "left").withColumn("cluster", F.coalesce("cluster", "context_key"))
    key = "cluster" if clusters is not None else "context_key"
    found, reasons = candidates(members(good, key), config)
    sampled = sample(found, config.per_capability)
    files = rows.agg(F.array_join(F.array_sort(F.collect_set("source_file")), ",")).first()[0]
    mined = freeze(sampled, stitched, config, F.lit(files), F.lit(pd.Timestamp.now("UTC").isoformat()))
    count = lambda kind, df, name: df.groupBy(F.lit(kind).alias("counter"), F.col(name).alias("name")).count()
    summary = count("skipped", marked.where("skip_reason IS NOT NULL"), "skip_reason").unionByName(count("candidates", found, "category")).unionByName(count("emitted", sampled, "category"))
    summary = summary.unionByName(reasons.select(F.lit("clusters").alias("counter"), F.col("reason").alias("name"), "count"))
    totals = marked.agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.when(F.col("skip_reason").isNull(), F.col("context_key"))).alias("contexts"))
    return mined, summary.unionByName(totals.select(F.lit("total").alias("counter"), F.explode(F.map_from_arrays(F.array(F.lit("sessions"), F.lit("contexts")), F.array("sessions", "contexts"))).alias("name", "count")))
