"""Queries over sessions, agreement and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining, sessions
from .base import EXCHANGES_SQL, exchanges, query, table

@query(f"WITH {EXCHANGES_SQL} SELECT conv_id, at_turn, CAST(len(norm) AS INTEGER) AS n_messages, array_to_string(norm, chr(10)) AS context, reply FROM ex")
def exchange_table(spark, d):
    return exchanges(spark, d).select("conv_id", F.col("at").alias("at_turn"), F.size("norm").alias("n_messages"), F.concat_ws("\n", "norm").alias("context"), "reply")


@query(f"WITH {EXCHANGES_SQL} SELECT conv_id, at_turn, list_filter(saids, lambda s, k: roles[k] = 'user')[-1] AS last_user FROM ex")
def trailing_user_turn(spark, d):
    said = F.get(F.reverse(F.filter("messages", lambda m: m["role"] == "user")), F.lit(0))["said"]
    return exchanges(spark, d).select("conv_id", F.col("at").alias("at_turn"), said.alias("last_user"))


@query(f"WITH {EXCHANGES_SQL} SELECT a.conv_id AS conv_id, a.at_turn AS a_turn, b.at_turn AS b_turn FROM ex a JOIN ex b ON a.conv_id = b.conv_id AND len(a.norm) < len(b.norm) AND b.norm[1:len(a.norm)] = a.norm")
def prefix_extension_pairs(spark, d):
    s = exchanges(spark, d).withColumn("turn", F.col("at"))
    return sessions.extensions(s, []).select(F.col("session_id").cast("long").alias("conv_id"), "a_turn", F.col("e_turn").alias("b_turn"))


_STITCH = f"""{EXCHANGES_SQL},
nodes AS (SELECT norm, min(conv_id * 1000 + at_turn) AS ord FROM ex GROUP BY norm),
inner_ AS (SELECT a.norm AS norm, max(len(p.norm)) AS k FROM nodes a JOIN nodes p ON len(p.norm) < len(a.norm) AND p.norm[1] = a.norm[1] AND a.norm[1:len(p.norm)] = p.norm GROUP BY a.norm),
placed AS (SELECT n.norm, n.ord, i.k, row_number() OVER (PARTITION BY n.norm[1:i.k] ORDER BY len(n.norm), n.ord) AS nth FROM nodes n LEFT JOIN inner_ i ON i.norm = n.norm),
starts AS (SELECT norm FROM placed WHERE k IS NULL OR nth > 1),
root AS (SELECT n.norm AS norm, max(len(s.norm)) AS k FROM nodes n JOIN starts s ON len(s.norm) <= len(n.norm) AND s.norm[1] = n.norm[1] AND n.norm[1:len(s.norm)] = s.norm GROUP BY n.norm),
stitched AS (SELECT ex.*, r.norm[1:r.k] AS root_norm FROM ex JOIN root r ON r.norm = ex.norm)"""


@query(f"WITH {_STITCH} SELECT conv_id, at_turn, min(conv_id * 1000 + at_turn) OVER (PARTITION BY root_norm) AS session_first FROM stitched")
def stitch_sessions(spark, d):
    """Conversations put together again without their ids; a session is named by its first row here, as hashes of JSON differ between engines."""
    s = sessions.stitch(exchanges(spark, d, labelled=False))
    return s.select("conv_id", F.col("at").alias("at_turn"), F.min("line_no").over(Window.partitionBy("session_id")).alias("session_first"))


@query(f"WITH {EXCHANGES_SQL} SELECT conv_id, at_turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY len(norm), conv_id * 1000 + at_turn) - 1 AS INTEGER) AS turn FROM ex")
def session_turns(spark, d):
    return sessions.with_turns(exchanges(spark, d)).select("conv_id", F.col("at").alias("at_turn"), "turn")


def _evidence(spark, d):
    """Exchanges as the mining code sees them: each assistant turn is also a call of a tool that its place names, and the second user turn of four is a
    tool's result, half of them errors."""
    name = lambda at: F.concat(F.lit("tool"), (at % 2).cast("string"))
    none = F.array().cast("array<string>")
    result = lambda m, k: (m["role"] == "user") & (k % 4 == 2)
    said = lambda m, k: F.when(result(m, k) & (F.length(m["said"]) % 2 == 0), F.concat(F.lit("Error: "), m["said"])).otherwise(m["said"])
    messages = F.transform("messages", lambda m, k: F.struct(F.when(result(m, k), "tool").otherwise(m["role"]).alias("role"), said(m, k).alias("content"), F.lit(None).cast("string").alias("name"), F.when(m["role"] == "assistant", F.array(name(k))).otherwise(none).alias("call_names"), said(m, k).alias("norm_content")))
    calls = F.array(F.struct(name(F.size("messages")).alias("name"), F.to_json(F.struct(F.substring("reply", 1, 2).alias("q"))).alias("arguments")))
    rows = exchanges(spark, d).withColumn("response", F.struct(F.col("reply").alias("content"), calls.alias("tool_calls"))).withColumn("messages", messages)
    return sessions.with_evidence(sessions.with_turns(rows))


_EVIDENCE = f"""{EXCHANGES_SQL},
u AS (
  SELECT *, list_transform(roles, lambda r, k: CASE WHEN r = 'user' AND k % 4 = 3 THEN 'tool' ELSE r END) AS rs, list_filter(saids, lambda s, k: roles[k] = 'user' AND k % 4 <> 3)[-1] AS asked, substr(reply, 1, 2) AS q FROM ex),
pairs AS (
  SELECT a.conv_id AS conv_id, a.at_turn AS at_turn, len(b.norm) AS n, b.at_turn AS e_turn, len(a.norm) AS la, a.asked AS asked, a.q AS aq, b.q AS eq, (len(b.norm) - len(a.norm)) % 2 = 0 AS same_tool,
    list_filter(b.saids, lambda s, k: k > len(a.norm) AND b.rs[k] = 'user') AS users, list_filter(b.saids, lambda s, k: k > len(a.norm) AND b.rs[k] = 'tool') AS results,
    len(list_filter(b.rs, lambda r, k: k > len(a.norm) AND r = 'assistant' AND (k - 1 - len(a.norm)) % 2 = 0)) > 0 AS fed
  FROM u a JOIN u b ON a.conv_id = b.conv_id AND len(a.norm) < len(b.norm) AND b.norm[1:len(a.norm)] = a.norm),
first_user AS (SELECT conv_id, at_turn, min(n) AS n FROM pairs WHERE len(users) > 0 GROUP BY 1, 2),
verdict AS (
  SELECT p.conv_id AS conv_id, p.at_turn AS at_turn, arg_min(fed AND len(results) > 0 AND length(results[1]) % 2 = 1, p.n) AS near,
    bool_or(same_tool AND aq <> eq AND (f.n IS NULL OR p.n < f.n)) AS retry, coalesce(bool_or(p.n = f.n AND users[1] = asked), false) AS stuck, bool_or(list_contains(users, asked)) AS again
  FROM pairs p LEFT JOIN first_user f ON f.conv_id = p.conv_id AND f.at_turn = p.at_turn GROUP BY 1, 2)"""


@query(f"WITH {_EVIDENCE} SELECT ex.conv_id AS conv_id, ex.at_turn AS at_turn, coalesce(again, false) AS reasked FROM ex LEFT JOIN verdict v ON v.conv_id = ex.conv_id AND v.at_turn = ex.at_turn")
def reask_detection(spark, d):
    """Whether the last user turn comes again later in the session."""
    return _evidence(spark, d).select("conv_id", F.col("at").alias("at_turn"), "reasked")


@query(f"WITH {_EVIDENCE} SELECT ex.conv_id AS conv_id, ex.at_turn AS at_turn, coalesce(near AND NOT retry AND NOT stuck, false) AS confirmed FROM ex LEFT JOIN verdict v ON v.conv_id = ex.conv_id AND v.at_turn = ex.at_turn")
def continuation_confirmed(spark, d):
    """Whether a call ran, its result went back without an error, and the talk moved on: not the same tool with other arguments, not the same question."""
    return _evidence(spark, d).select("conv_id", F.col("at").alias("at_turn"), "confirmed")


@query(
    """SELECT event_type AS tool, 'c' || CAST(user_id % 10 AS VARCHAR) AS category, event_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY CAST(event_id % 7 AS DOUBLE), CAST(json_extract(props, '$.k') AS BIGINT) DESC, ts DESC, CAST(user_id AS VARCHAR), event_id) AS rank FROM events) WHERE rank <= 8"""
)
def sample_topk(spark, d):
    """The per-group sample of mining: at most eight, the clearest, then the longest, then the latest."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    e = table(spark, d, "events").select(F.col("event_type").alias("tool"), F.lit("").alias("toolset"), F.concat(F.lit("c"), (F.col("user_id") % 10).cast("string")).alias("category"), (F.col("event_id") % 7).cast("double").alias("overlap"), k.alias("n_messages"), F.col("ts").alias("turn"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("line_no"), F.lit(0).alias("file_ord"), "event_id")
    got = mining.sample(e, 8)
    order = Window.partitionBy("tool", "category").orderBy("overlap", F.desc("n_messages"), F.desc("turn"), "session_id", "line_no")
    return got.select("tool", "category", "event_id", F.row_number().over(order).alias("rank"))


@query(
    """WITH n AS (SELECT event_id, 'trace:' || CAST(user_id AS VARCHAR) || ':t' || CAST(event_id % 3 AS VARCHAR) AS id, event_type AS category FROM events)
SELECT event_id, id || repeat('+', row_number() OVER (PARTITION BY id, category ORDER BY event_id) - 1) AS id, category FROM n"""
)
def id_collision_suffix(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("trace:"), F.col("user_id").cast("string"), F.lit(":t"), (F.col("event_id") % 3).cast("string")).alias("id"), F.col("event_type").alias("category"))
    return mining.with_suffix(e, [F.col("event_id")])


@query(
    """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'schema_validity' WHEN quality = 1 THEN 'tool_selection' ELSE 'no_tool' END AS category,
CASE WHEN doc_id % 3 <> 0 THEN 'rejected' WHEN quality = 1 AND toxic = 0 THEN 'accepted' ELSE 'pending' END AS status FROM labels"""
)
def trust_ladder(spark, d):
    """Only pending rows of a trusted category are accepted unseen."""
    from ..operators.probes import auto_accept

    category = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "schema_validity").when(F.col("quality") == 1, "tool_selection").otherwise("no_tool")
    rows = table(spark, d, "labels").select("doc_id", category.alias("category"), F.when(F.col("doc_id") % 3 != 0, "rejected").otherwise("pending").alias("status"))
    return auto_accept(rows)


@query("SELECT CASE WHEN doc_id % 3 <> 0 THEN 'rejected' WHEN quality = 1 AND toxic = 0 THEN 'accepted' ELSE 'pending' END AS status, count(*) AS n FROM labels GROUP BY 1")
def review_summary(spark, d):
    return trust_ladder(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def _all_calls(spark, d):
    """Exchanges of the whole mining path, from events: a context per props value, a session per user and day."""
    e = table(spark, d, "events")
    sid = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
    tool = lambda n: F.struct(F.lit(n).alias("name"), F.lit(f"does {n}").alias("description"), F.lit("{}").alias("parameters"), F.lit("{}").alias("raw"), F.lit(f'"{n}"').alias("norm"))
    return e.select(
        F.concat_ws("|", "props", (F.col("user_id") % 20).cast("string")).alias("context_key"), sid.alias("session_id"), F.col("event_id").cast("int").alias("turn"), F.lit(0).alias("file_ord"), F.col("event_id").alias("line_no"), F.lit(False).alias("confirmed"), F.lit(False).alias("reasked"),
        F.array("props").alias("norm"), F.array(F.struct(F.lit("user").alias("role"), F.col("props").alias("norm_content"))).alias("messages"), F.array(tool("purchase"), tool("signup")).alias("tools"),
        F.struct(F.when(F.col("event_type").isin("view", "click"), F.lit("said")).alias("content"), F.when(F.col("event_type").isin("view", "click"), F.array().cast("array<struct<name:string,arguments:string>>")).otherwise(F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments")))).alias("tool_calls")).alias("response"),
    )


_CALLS_SQL = """
m AS (SELECT props || '|' || CAST(user_id % 20 AS VARCHAR) AS props, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS sid, event_id, event_type, event_type IN ('purchase', 'signup', 'error') AS caller, event_type IN ('purchase', 'signup') AS valid FROM events),
named AS (SELECT props, event_type, count(DISTINCT sid) AS n FROM m WHERE valid GROUP BY 1, 2),
agreed AS (SELECT props, count(*) FILTER (n >= 2) AS agreeing, max(n) FILTER (n >= 2) AS n FROM named GROUP BY 1),
by_ctx AS (SELECT props, count(*) FILTER (caller) AS callers, count(*) FILTER (valid) AS valids, count(DISTINCT sid) FILTER (valid) AS n_valid, count(DISTINCT sid) FILTER (NOT caller) AS n_quiet FROM m GROUP BY 1)"""


_FOUND = f"""{_CALLS_SQL},
rep AS (
  SELECT props, arg_min(event_id, (sid, event_id)) AS rep, arg_min(event_id, (sid, event_id)) FILTER (valid) AS rep_valid FROM m GROUP BY 1),
named_rep AS (SELECT m.props AS props, arg_min(m.event_id, (sid, m.event_id)) AS rep, any_value(m.event_type) AS tool FROM m JOIN named USING (props, event_type) WHERE valid AND named.n >= 2 GROUP BY m.props, m.event_type)"""


def _found(spark, d, category):
    found, _ = mining.candidates(mining.members(_all_calls(spark, d)))
    return found.where(F.col("category") == category).select(F.col("line_no").alias("event_id"), "tool", "rule", "sessions")


@query(f"WITH {_FOUND} SELECT rep_valid AS event_id, e.event_type AS tool, 'schema-validity' AS rule, CAST(n_valid AS INTEGER) AS sessions FROM by_ctx JOIN rep USING (props) JOIN events e ON e.event_id = rep_valid WHERE valids > 0")
def distinct_session_agreement(spark, d):
    """Exact distinct counts of sessions: an estimate could mint an agreement that isn't there."""
    return _found(spark, d, "schema_validity")


@query(f"WITH {_FOUND} SELECT named_rep.rep AS event_id, tool, 'min-agreement' AS rule, CAST(agreed.n AS INTEGER) AS sessions FROM agreed JOIN named_rep USING (props) WHERE agreeing = 1")
def agreement_verdict(spark, d):
    """A context is confirmed when sessions agree on exactly one tool."""
    return _found(spark, d, "tool_selection")


@query(f"WITH {_FOUND} SELECT rep AS event_id, CAST(NULL AS VARCHAR) AS tool, 'min-agreement-notool' AS rule, CAST(n_quiet AS INTEGER) AS sessions FROM by_ctx JOIN rep USING (props) WHERE callers = 0 AND n_quiet >= 3")
def no_tool_unanimous(spark, d):
    """Contexts in which nobody ever called: one caller is enough to drop them."""
    return _found(spark, d, "no_tool")


@query(
    f"""WITH {_CALLS_SQL},
c AS (
  SELECT 'schema_validity' AS category, n_valid AS sessions FROM by_ctx WHERE valids > 0
  UNION ALL SELECT 'tool_selection', a.n FROM agreed a WHERE agreeing = 1
  UNION ALL SELECT 'no_tool', n_quiet FROM by_ctx WHERE callers = 0 AND n_quiet >= 3)
SELECT category, count(*) AS candidates, CAST(sum(sessions) AS BIGINT) AS sessions FROM c GROUP BY 1"""
)
def mining_candidates(spark, d):
    """Cluster, infer and count: the candidates of every context."""
    found, _ = mining.candidates(mining.members(_all_calls(spark, d)))
    return found.groupBy("category").agg(F.count("*").alias("candidates"), F.sum("sessions").alias("sessions"))


@query(
    f"""WITH {_CALLS_SQL}
SELECT reason, count(*) AS count FROM (
  SELECT CASE WHEN callers > 0 AND valids = 0 THEN 'called_tool_not_offered' WHEN valids > 0 AND agreeing > 1 THEN 'ambiguous_tool_selection' WHEN valids > 0 AND agreeing = 0 THEN 'unconfirmed_tool_clusters' END AS reason
  FROM by_ctx LEFT JOIN agreed USING (props)) WHERE reason IS NOT NULL GROUP BY 1"""
)
def mining_reasons(spark, d):
    _, reasons = mining.candidates(mining.members(_all_calls(spark, d)))
    return reasons


@query("SELECT event_id, event_type || ' ' || CAST(event_id % 3 AS VARCHAR) AS expected, json_extract_string(props, '$.k') = '7' AND event_type = 'view' AS same FROM events")
def retry_arguments(spark, d):
    """Arguments are compared in canonical form: the order of keys, clock readings and blanks inside strings make no difference."""
    e = table(spark, d, "events")
    clock, k = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    given = F.concat(F.lit('{ "what" : ["'), F.lit("\u00a0"), clock, F.lit("\\n  "), "event_type", F.lit('"], "k":'), k.cast("string"), F.lit("}"))
    said = F.concat(F.lit("  "), "event_type", F.lit("\u2003"), F.lit("\u00a0"), (F.col("event_id") % 3).cast("string"))
    return e.select("event_id", T.norm_args(said).alias("expected"), (T.norm_args(given) == F.lit('{"k":7,"what":["<ts> view"]}')).alias("same"))
