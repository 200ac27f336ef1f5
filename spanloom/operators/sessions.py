"""Sessions out of exchanges: stitching, turns, and what a session says about an earlier exchange.

Stitching without labels is no loop over open sessions. A node is a distinct list of messages; its parent is the longest proper prefix that is
itself a node. The first child of a node, by (length, time, place), goes on with its session, any other starts one, as does a node without parent;
a node's session is that of the longest start among its prefixes. Prefixes are found by equi-joins on rolling hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shipping import ship


def chain(parts: Column) -> Column:
    """The rolling hash of each prefix of a list of strings."""
    return F.slice(F.aggregate(parts, F.array(F.lit("")), lambda acc, m: F.concat(acc, F.array(F.md5(F.concat(F.element_at(acc, -1), F.md5(m)))))), 2, F.greatest(F.size(parts), F.lit(1)))


def session_name(norm: Column) -> Column:
    return F.concat(F.lit("sha256:"), T.hash_text(F.to_json(norm)))


def roots(nodes: DataFrame) -> DataFrame:
    """(key, root) of nodes (key, chain, ord): the start of each node's session. ord is any sortable order among nodes of one length."""
    each = nodes.select("key", F.size("chain").alias("n"), "ord", F.posexplode("chain").alias("at", "prefix")).withColumn("k", F.col("at") + 1)
    known = nodes.select(F.col("key").alias("prefix"))
    inner = each.where("k < n").join(known, "prefix").groupBy("key").agg(F.max_by("prefix", "k").alias("parent"))
    first = F.row_number().over(Window.partitionBy("parent").orderBy("n", "ord", "key"))
    placed = nodes.select("key", F.size("chain").alias("n"), "ord").join(inner, "key", "left").withColumn("nth", first)
    starts = placed.where("parent IS NULL OR nth > 1").select(F.col("key").alias("prefix"))
    return each.join(starts, "prefix").groupBy("key").agg(F.max_by("prefix", "k").alias("root"))


def _unlabelled(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("__chain", chain(F.col("norm"))).withColumn("__key", F.element_at("__chain", -1))
    nodes = rows.groupBy(F.col("__key").alias("key")).agg(F.first("__chain").alias("chain"), F.min(F.struct("ts", "file_ord", "line_no")).alias("ord"), F.first(session_name(F.col("norm"))).alias("name"))
    named = roots(nodes.select("key", "chain", "ord")).join(nodes.select(F.col("key").alias("root"), "name"), "root")
    return rows.join(named.select(F.col("key").alias("__key"), "name"), "__key").withColumn("session_id", F.col("name")).drop("__chain", "__key", "name")


def _greedy(rows: list[tuple]) -> Iterator[str]:
    """Session of each (session_id, norm, ts, file_ord, line_no) where some have a label: attach to the longest tail that is a prefix."""
    order = lambda k: (len(rows[k][1]), rows[k][2] or "", rows[k][4], rows[k][3])
    tails: dict[int, list] = {}
    label: dict[int, str] = {}
    groups: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        if r[0]:
            groups.setdefault(r[0], []).append(k)
    out: dict[int, str] = {}
    opened = 0
    for name, own in groups.items():
        tails[opened], label[opened] = rows[max(own, key=order)][1], name
        out |= dict.fromkeys(own, name)
        opened += 1
    from ..functions.schema import dumps

    for k in sorted((k for k, r in enumerate(rows) if not r[0]), key=order):
        norm = rows[k][1]
        fit = [s for s, tail in tails.items() if norm[: len(tail)] == tail]
        if fit:
            s = max(fit, key=lambda s: (len(tails[s]), -s))
        else:
            import hashlib

            s, opened = opened, opened + 1
            label[s] = "sha256:" + hashlib.sha256(dumps(norm).encode()).hexdigest()[:16]
        tails[s] = norm
        out[k] = label[s]
    return (out[k] for k in range(len(rows)))


def _mixed(rows: DataFrame) -> DataFrame:
    """Labelled tails are open from the start, which only a walk can follow. Nodes are the unlabelled lists of messages and the tails; all nodes of which
    one is a prefix of another share their shortest prefix that is a node. So walks are independent by that prefix, and those without a labelled tail
    are stitched by joins. A shared system prompt is no node, unless it was sent alone."""
    ship(rows.sparkSession)
    order = Window.partitionBy("session_id").orderBy(F.size("norm").desc(), F.desc("ts"), F.desc("line_no"), F.desc("file_ord"))
    rows = rows.withColumn("__chain", chain(F.col("norm"))).withColumn("__key", F.element_at("__chain", -1)).withColumn("__tail", F.col("session_id").isNotNull() & (F.row_number().over(order) == 1))
    part = rows.where(F.col("session_id").isNull() | F.col("__tail"))
    nodes = part.groupBy("__key").agg(F.first("__chain").alias("chain"))
    each = nodes.select("__key", F.posexplode("chain").alias("k", "prefix"))
    place = each.join(nodes.select(F.col("__key").alias("prefix")), "prefix").groupBy("__key").agg(F.min_by("prefix", "k").alias("__place"))
    part = part.join(place, "__key").drop("__chain", "__key", "__tail")
    walked = part.where("session_id IS NOT NULL").select("__place").distinct().withColumn("__walk", F.lit(True))
    part = part.join(walked, "__place", "left")
    kept = [f.name for f in rows.schema.fields if not f.name.startswith("__")]
    schema = rows.select(*kept).schema

    def run(table: pa.Table) -> pa.Table:
        at = table.column_names.index("session_id")
        found = _greedy([*zip(*(table.column(c).to_pylist() for c in ("session_id", "norm", "ts", "file_ord", "line_no")))])
        return table.drop_columns(["__place"]).set_column(at, "session_id", pa.array([*found], table.schema.field(at).type))

    walks = part.where("__walk").select(*kept, "__place").groupBy("__place").applyInArrow(run, schema)
    plain = _unlabelled(part.where("__walk IS NULL").select(*kept)).select(*kept)
    return rows.where(F.col("session_id").isNotNull() & ~F.col("__tail")).select(*kept).unionByName(plain).unionByName(walks)


def with_turns(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy(F.size("norm"), "ts", "file_ord", "line_no", F.xxhash64("norm"))
    return rows.withColumn("turn", F.row_number().over(order) - 1)


def stitch(exchanges: DataFrame) -> DataFrame:
    """Exchanges with session_id for all, and turn. Needs session_id, ts, file_ord, line_no and norm, an array of normalized messages.

    Given labels win. Two lists of messages that are equal are one conversation logged twice. A branch starts a session.
    """
    rows = exchanges.withColumn("session_id", F.when(F.col("session_id") != "", F.col("session_id")))
    kinds = {r[0] for r in rows.select(F.col("session_id").isNull().alias("k")).distinct().collect()}
    if kinds == {True}:
        rows = _unlabelled(rows)
    elif kinds == {True, False}:
        rows = _mixed(rows)
    return with_turns(rows)


def extensions(sessions: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of an exchange (a_*) and a later one of its session (e_*) whose messages extend its own: an equi-join on the hashes of e's proper prefixes,
    as a session of many exchanges that extend none of each other would give all its pairs otherwise."""
    whole = F.concat(F.array(F.lit("")), F.when(F.size("norm") > 0, chain(F.col("norm"))).otherwise(F.array().cast("array<string>")))
    named = sessions.where("norm IS NOT NULL").withColumn("__chain", whole)
    a = named.select("session_id", F.element_at("__chain", -1).alias("__key"), *[F.col(c).alias(f"a_{c}") for c in ("turn", "norm", *columns)])
    e = named.select("session_id", F.explode(F.slice("__chain", 1, F.size("__chain") - 1)).alias("__key"), *[F.col(c).alias(f"e_{c}") for c in ("turn", "norm", *columns)])
    longer = (F.size("a_norm") < F.size("e_norm")) & (F.slice("e_norm", 1, F.size("a_norm")) == F.col("a_norm"))
    return a.join(e, ["session_id", "__key"]).where(longer).drop("__key")


def last_user(messages: Column) -> Column:
    return F.get(F.reverse(F.filter(messages, lambda m: m["role"] == "user")), F.lit(0))["norm_content"]


def with_evidence(sessions: DataFrame) -> DataFrame:
    """sessions with `confirmed` (the first call ran, its result went back, and the talk moved on) and `reasked` (the same user turn came again).

    The shortest extension must hold an assistant message with the call and a tool message, whose content is no error. Extensions are then
    walked by length: the first with a new user turn decides, by whether it repeats the last one; before it, the same tool with other arguments
    is a retry.
    """
    args = T.norm_args_each(F.transform("response.tool_calls", lambda c: c["arguments"]))
    pairs = extensions(sessions.withColumn("args", args), ["messages", "response", "args"])
    new = F.slice("e_messages", F.size("a_messages") + 1, F.greatest(F.size("e_messages") - F.size("a_messages"), F.lit(0)))
    call = F.get("a_response.tool_calls", F.lit(0))
    users = F.filter(new, lambda m: m["role"] == "user")
    results = F.filter(new, lambda m: m["role"] == "tool")
    result = F.coalesce(F.get(F.filter(results, lambda m: m["name"] == call["name"]), F.lit(0)), F.get(results, F.lit(0)))
    told = pairs.select(
        "session_id", "a_turn", F.size("e_norm").alias("n"), "e_turn",
        (F.size(users) > 0).alias("has_user"), F.get(users, F.lit(0))["norm_content"].alias("user"),
        F.exists(new, lambda m: (m["role"] == "assistant") & F.array_contains(m["call_names"], call["name"])).alias("fed"), (F.size(results) > 0).alias("has_result"), result["content"].alias("result"),
        F.exists(F.zip_with("e_response.tool_calls", "e_args", lambda c, x: (c["name"] == call["name"]) & (x != F.get("a_args", F.lit(0)))), lambda x: x).alias("retry"),
        F.exists(users, lambda m: m["norm_content"].eqNullSafe(last_user(F.col("a_messages")))).alias("again"), last_user(F.col("a_messages")).alias("asked"),
    )
    fields = ["n", "e_turn", "has_user", "user", "fed", "has_result", "result", "retry"]
    walk = told.groupBy("session_id", F.col("a_turn").alias("turn")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("walk"), F.first("asked").alias("asked"), F.bool_or("again").alias("again"))
    at = F.array_position(F.transform("walk", lambda x: x["has_user"]), True)
    before = F.when(at > 0, F.slice("walk", 1, F.greatest(at.cast("int") - 1, F.lit(0)))).otherwise(F.col("walk"))
    decided = F.when(at > 0, ~(F.col("asked").isNotNull() & F.get("walk", (at - 1).cast("int"))["user"].eqNullSafe(F.col("asked")))).otherwise(True)
    near = F.get("walk", F.lit(0))
    moved_on = near["fed"] & near["has_result"] & ~T.looks_like_error(near["result"]) & ~F.exists(before, lambda x: x["retry"]) & decided
    verdict = walk.select("session_id", "turn", moved_on.alias("__moved"), (F.col("again") & F.col("asked").isNotNull()).alias("__again"))
    out = sessions.join(verdict, ["session_id", "turn"], "left")
    return out.withColumn("confirmed", (F.size("response.tool_calls") > 0) & F.coalesce("__moved", F.lit(False))).withColumn("reasked", F.coalesce("__again", F.lit(False))).drop("__moved", "__again")
