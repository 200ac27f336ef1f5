"""Queries over scoring, scorecards and their comparison."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.stats import critical_value, significant_regression
from ..operators import compare, health, probes, scoring, simulate
from .base import query, table

HALF = "2024-01-16"
Z = critical_value(0.95)

# --- scorers ---

_RESP = """
resp AS (
  SELECT user_id, ctx, list(event_type ORDER BY event_type) FILTER (event_type IN ('purchase', 'signup', 'error')) AS calls_, max(event_type) AS content
  FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS ctx, event_type FROM events) GROUP BY 1, 2),
r AS (SELECT user_id, ctx, coalesce(calls_, []) AS calls, content FROM resp)"""


def _responses(spark, d):
    """A response a user and context: the calls made, and a word as text."""
    e = table(spark, d, "events").select("user_id", (F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 10).alias("ctx"), "event_type")
    called = F.when(F.col("event_type").isin("purchase", "signup", "error"), F.struct(F.col("event_type").alias("name"), F.lit("{}").alias("arguments")))
    return e.groupBy("user_id", "ctx").agg(F.array_sort(F.collect_list(called)).alias("tool_calls"), F.max("event_type").alias("content"))


def _scorer(name: str, sql: str, rule):
    def run(spark, d):
        r = _responses(spark, d)
        return r.select("user_id", "ctx", rule(r).cast("double").alias("score"))

    run.__name__ = name
    query(f"WITH {_RESP} SELECT user_id, ctx, CAST({sql} AS DOUBLE) AS score FROM r")(run)


_CALLS = lambda r: F.col("tool_calls")
_scorer("score_selection", "list_contains(calls, 'purchase')", lambda r: scoring.calls_tool(_CALLS(r), F.lit("purchase")))
_scorer("score_any_call", "len(calls) > 0", lambda r: scoring.calls_tool(_CALLS(r), F.lit(None).cast("string")))
_scorer("score_discrimination", "list_contains(calls, 'purchase') AND len(list_filter(calls, lambda c: c <> 'purchase')) = 0", lambda r: scoring.calls_only(_CALLS(r), F.lit("purchase")))
_scorer("score_restraint", "len(calls) = 0", lambda r: scoring.no_call(_CALLS(r)))
_scorer("score_permission", "NOT list_contains(calls, 'signup')", lambda r: scoring.avoids(_CALLS(r), F.lit("signup")))
_scorer("score_no_hallucination", "len(list_filter(calls, lambda c: c NOT IN ('purchase', 'signup'))) = 0", lambda r: scoring.calls_offered(_CALLS(r), F.array(F.lit("purchase"), F.lit("signup"))))
_scorer("score_format", "content = 'view'", lambda r: scoring.says(F.concat(F.lit(" "), "content", F.lit("\n")), F.lit("view")))

_SCHEMA = json.dumps({"type": "object", "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80, "multipleOf": 2}}, "required": ["k"]})


def _deep(name: str, capability: str, sql: str, schema: str = _SCHEMA, arguments: str = "props", content: str = "NULL"):
    def run(spark, d):
        tools = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("").alias("description"), F.lit(s).alias("parameters")) for n, s in (("purchase", schema), ("signup", json.dumps({"properties": {"k": {"maximum": 50}}})))])
        rows = table(spark, d, "events").select(
            "event_id", F.lit(capability).alias("capability"), F.lit("purchase").alias("expected_tool"), F.lit(None).cast("string").alias("expected_text"), F.lit(schema).alias("schema"), tools.alias("tools"),
            F.struct(F.expr(content).cast("string").alias("content"), F.array(F.struct(F.col("event_type").alias("name"), F.expr(arguments).alias("arguments"))).alias("tool_calls")).alias("response"),
        )
        return scoring.score(rows).select("event_id", "score")

    run.__name__ = name
    query(f"WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CAST({sql} AS DOUBLE) AS score FROM e")(run)


_BUY = "event_type = 'purchase'"
_deep("score_arg_validity", "arg_validity", f"{_BUY} AND k BETWEEN 10 AND 80 AND k % 2 = 0")
_deep("score_required_args", "required_args", f"{_BUY} AND k % 3 <> 0", arguments="CASE WHEN try_variant_get(parse_json(props), '$.k', 'bigint') % 3 = 0 THEN '{\"k\": \"\"}' ELSE props END")
_deep("score_arity", "arity_robustness", f"{_BUY} AND k > 50", schema=json.dumps({"properties": {"k": {"type": "integer"}, "o": {"type": "object", "properties": {"x": {}}}}}), arguments="CASE WHEN try_variant_get(parse_json(props), '$.k', 'bigint') > 50 THEN '{\"k\": 0, \"o\": {\"x\": false}}' ELSE '{\"k\": 1, \"o\": {}}' END")
_deep("score_structured_output", "structured_output", "event_id % 2 = 0 AND k BETWEEN 10 AND 80 AND k % 2 = 0", content="CASE WHEN event_id % 2 = 0 THEN concat(' ', props, '\\n') ELSE concat('Sure: ', props) END")
_deep("score_own_schema", "traced_schema_validity", f"({_BUY} AND k BETWEEN 10 AND 80 AND k % 2 = 0) OR (event_type = 'signup' AND k <= 50)")

# --- aggregation ---


def _samples(spark, d):
    """Each event a sample: the user is the probe, the type of the latest day the capability, an odd k a pass, `error` a failed request."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    cap = F.element_at(F.array(*[F.lit(c) for c in ("tool_selection", "tool_restraint", "arg_validity", "tool_permission", "format_adherence")]), (F.col("user_id") % 5 + 1).cast("int"))
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").select(F.col("user_id").alias("probe_id"), cap.alias("capability"), F.col("event_id").alias("sample_no"), (k % 2).cast("double").alias("score"), F.when(bad, F.concat(F.lit("timeout "), F.col("event_id").cast("string"))).alias("error"), "ts")


_SAMPLES = """
s AS (
  SELECT user_id AS probe_id, ['tool_selection', 'tool_restraint', 'arg_validity', 'tool_permission', 'format_adherence'][user_id % 5 + 1] AS capability, event_id AS sample_no,
         CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 2 AS DOUBLE) AS raw, event_type = 'error' AS bad, ts FROM events),
scored AS (SELECT *, CASE WHEN bad THEN CASE WHEN capability IN ('tool_restraint', 'tool_permission') THEN 1.0 ELSE 0.0 END ELSE raw END AS score FROM s),
rates AS (SELECT probe_id, capability, avg(score) AS score, CASE WHEN bool_and(bad) THEN 'timeout ' || CAST(max(sample_no) AS VARCHAR) END AS error, count(*) AS samples FROM scored GROUP BY 1, 2)"""


@query(f"WITH {_SAMPLES} SELECT * FROM rates")
def probe_pass_rate(spark, d):
    return scoring.pass_rates(_samples(spark, d))


@query(f"WITH {_SAMPLES} SELECT capability, round_even(avg(score), 4) AS score FROM rates GROUP BY 1")
def capability_scores(spark, d):
    return scoring.capability_scores(scoring.pass_rates(_samples(spark, d)))


@query(f"WITH {_SAMPLES} SELECT capability, count(*) * max(samples) AS trials FROM rates GROUP BY 1")
def capability_trials(spark, d):
    return compare.trials(scoring.pass_rates(_samples(spark, d)), F.col("samples"))


@query(f"WITH {_SAMPLES} SELECT capability, count(*) FILTER (error IS NOT NULL) AS errored, count(*) AS total FROM rates WHERE capability IN ('tool_restraint', 'tool_permission') GROUP BY 1 HAVING count(*) FILTER (error IS NOT NULL) > 0")
def error_derived_negatives(spark, d):
    return scoring.error_negatives(scoring.pass_rates(_samples(spark, d)))


@query(f"WITH {_SAMPLES} SELECT coalesce(bool_and(error IS NOT NULL), false) AS all_errored FROM rates")
def all_errored_guard(spark, d):
    return spark.createDataFrame([(scoring.all_errored(scoring.pass_rates(_samples(spark, d))),)], "all_errored boolean")


# --- comparison ---

_CARD = f"""
card AS (
  SELECT ts < TIMESTAMP '{HALF}' AS is_base, user_id % 50 AS lock_id, CASE WHEN user_id % 7 = 0 AND ts >= TIMESTAMP '{HALF}' THEN 'extra' ELSE event_type END AS capability,
         CAST(CAST(json_extract(props, '$.k') AS BIGINT) > 40 AS INTEGER) AS ok FROM events),
scores AS (SELECT is_base, lock_id, capability, round_even(avg(ok), 4) AS score, count(*) AS trials FROM card GROUP BY 1, 2, 3),
pair_ AS (
  SELECT coalesce(b.lock_id, c.lock_id) AS lock_id, coalesce(b.capability, c.capability) AS capability, b.score AS baseline, c.score AS candidate, round_even(c.score - b.score, 4) AS delta, b.trials AS nb, c.trials AS nc
  FROM (SELECT * FROM scores WHERE is_base) b FULL JOIN (SELECT * FROM scores WHERE NOT is_base) c ON b.lock_id = c.lock_id AND b.capability = c.capability),
pooled AS (SELECT *, (round_even(baseline * nb, 0) + round_even(candidate * nc, 0)) / (nb + nc) AS p FROM pair_),
tested AS (SELECT *, p * (1 - p) * (1.0::DOUBLE / nb + 1.0::DOUBLE / nc) AS v FROM pooled),
judged AS (SELECT *, CASE WHEN delta < -0.05 THEN CASE WHEN candidate >= baseline THEN false WHEN v <= 0 THEN true ELSE (baseline - candidate) / sqrt(CASE WHEN v > 0 THEN v ELSE 1 END) > {Z!r} END END AS significant FROM tested),
diff AS (
  SELECT lock_id, capability, baseline, candidate, delta, significant, CASE WHEN baseline IS NULL THEN 'added' WHEN candidate IS NULL THEN 'removed' WHEN delta < -0.05 THEN CASE WHEN significant THEN 'regression' ELSE 'noisy' END WHEN delta > 0.05 THEN 'improved' ELSE 'ok' END AS status FROM judged)"""


def _cards(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    base = F.col("ts") < F.lit(HALF).cast("timestamp")
    e = table(spark, d, "events").select(base.alias("is_base"), (F.col("user_id") % 50).alias("lock_id"), F.when((F.col("user_id") % 7 == 0) & ~base, "extra").otherwise(F.col("event_type")).alias("capability"), (k > 40).cast("int").alias("ok"))
    s = e.groupBy("is_base", "lock_id", "capability").agg(F.bround(F.avg("ok"), 4).alias("score"), F.count("*").alias("trials"))
    return s.where("is_base"), s.where("NOT is_base")


@query(f"WITH {_CARD} SELECT * FROM diff")
def scorecard_diff(spark, d):
    """A fleet of scorecards, each against its earlier self, in one plan."""
    return compare.diff(*_cards(spark, d), confidence=0.95, keys=("lock_id",))


@query(f"WITH {_CARD} SELECT lock_id, CAST(max(CASE WHEN status IN ('regression', 'removed') THEN 1 ELSE 0 END) AS INTEGER) AS exit_code, count(*) FILTER (status = 'noisy') AS noisy FROM diff GROUP BY 1")
def scorecard_gate(spark, d):
    """Exit codes: 1 where a capability regressed or went."""
    rows = scorecard_diff(spark, d)
    return rows.groupBy("lock_id").agg(F.max(compare.failed(F.col("status")).cast("int")).alias("exit_code"), F.count_if(F.col("status") == "noisy").alias("noisy"))


@query("SELECT CAST(NULL AS VARCHAR) IS DISTINCT FROM max(n_name) AS tools_changed, max(n_name) IS DISTINCT FROM max(n_name) AS traces_changed FROM nation")
def fingerprints_changed(spark, d):
    name = table(spark, d, "nation").agg(F.max("n_name").alias("n"))
    a = name.select(F.lit(None).cast("string").alias("tools_fingerprint"), F.col("n").alias("traces_fingerprint"))
    return compare.changed(a, name.select(F.col("n").alias("tools_fingerprint"), F.col("n").alias("traces_fingerprint")))


@query(
    f"""WITH t AS (SELECT d.lang AS lang, d.source AS source, count(*) AS n, avg(l.quality) AS p FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2),
pairs AS (SELECT b.source AS source, b.p AS pb, b.n AS nb, c.p AS pc, c.n AS nc FROM t b JOIN t c ON b.source = c.source AND b.lang = 'en' AND c.lang = 'fr'),
v AS (SELECT *, (round_even(pb * nb, 0) + round_even(pc * nc, 0)) / (nb + nc) AS q FROM pairs)
SELECT source, CASE WHEN pc >= pb THEN false WHEN q * (1 - q) * (1.0::DOUBLE / nb + 1.0::DOUBLE / nc) <= 0 THEN true ELSE (pb - pc) / sqrt(q * (1 - q) * (1.0::DOUBLE / nb + 1.0::DOUBLE / nc)) > {Z!r} END AS significant FROM v"""
)
def significance_test(spark, d):
    """Labelled quality as Bernoulli trials: English against French, a test a source."""
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("quality").alias("p"))
    b, c = (t.where(F.col("lang") == x).select("source", F.col("p").alias(f"p{y}"), F.col("n").alias(f"n{y}")) for x, y in (("en", "b"), ("fr", "c")))
    return b.join(c, "source").select("source", significant_regression(F.col("pb"), F.col("nb"), F.col("pc"), F.col("nc"), 0.95).alias("significant"))


_LADDER = """
rung AS (SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS capability, CAST(year(l_shipdate) - 1992 AS INTEGER) AS pos, round_even(avg(CASE WHEN l_discount > 0.04 THEN 1.0 ELSE 0.0 END), 4) AS score FROM lineitem GROUP BY 1, 2),
step AS (SELECT *, round_even(score - lag(score) OVER (PARTITION BY capability ORDER BY pos), 4) AS step FROM rung),
each AS (SELECT capability, map_from_entries(list({'k': pos, 'v': score})) AS at_, arg_min(score, pos) AS first_, arg_max(score, pos) AS last_, max(pos) AS top, count(*) AS n, min(step) AS worst, coalesce(bool_and(step <= 0), true) OR coalesce(bool_and(step >= 0), true) AS monotonic FROM step GROUP BY 1)"""


@query(
    f"""WITH {_LADDER}
SELECT capability, array_to_string(list_transform(range(0, 7), lambda k: coalesce(CAST(CAST(round_even(element_at(at_, CAST(k AS INTEGER))[1] * 10000.0, 0) AS BIGINT) AS VARCHAR), '-')), ' ') AS ladder, CASE WHEN n >= 2 THEN round_even(last_ - first_, 4) END AS delta, CASE WHEN n >= 2 THEN worst END AS worst_step, monotonic,
       CASE WHEN top < 6 THEN 'removed' WHEN n < 2 THEN 'partial' WHEN round_even(last_ - first_, 4) < -0.05 THEN 'regressed' WHEN round_even(last_ - first_, 4) > 0.05 THEN 'improved' WHEN worst < -0.05 THEN 'unstable' ELSE 'stable' END AS status FROM each"""
)
def trend_ladder(spark, d):
    """Seven years as the rungs of a ladder, over all lines."""
    pos = F.year("l_shipdate") - 1992
    r = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("capability"), pos.alias("pos")).agg(F.bround(F.avg((F.col("l_discount") > 0.04).cast("double")), 4).alias("score"))
    ladder = F.array_join(F.transform("values", lambda v: F.coalesce(F.bround(v * 10000, 0).cast("long").cast("string"), F.lit("-"))), " ")
    return compare.trend(r, 7).select("capability", ladder.alias("ladder"), "delta", "worst_step", "monotonic", "status")


# --- batteries and health ---

_CAPS = ("tool_selection", "tool_discrimination", "needle_in_tools", "tool_permission", "no_hallucinated_tool", "arg_validity", "required_args", "arity_robustness", "structured_output")


def _part_tools(spark, d):
    """A tool for each distinct name of a part, as the last part of that name has it; every twentieth part is called `twice`."""
    kinds = {0: {}, 1: {"type": "object", "properties": {"size": {"type": "integer"}}, "required": ["size"]}, 2: {"type": "object", "properties": {"note": {"description": "anything"}}}}
    name = F.when(F.col("p_partkey") % 20 == 0, "twice").otherwise(F.col("p_name"))
    last = table(spark, d, "part").groupBy(name.alias("name")).agg(F.max_by(F.struct("p_type", "p_size"), "p_partkey").alias("p"))
    return [{"type": "function", "function": {"name": r.name, "description": f"Handles {r.p_type}.", "parameters": kinds[r.p_size % 3]}} for r in last.select("name", "p.*").orderBy("name").collect()]


@query(
    f"""WITH t AS (SELECT DISTINCT p_brand AS name FROM part), c(capability) AS (VALUES {", ".join(f"('{c}')" for c in _CAPS)})
SELECT capability || '::' || name AS id, capability, CASE WHEN capability NOT IN ('structured_output', 'no_hallucinated_tool') THEN name END AS expected_tool,
       CAST(CASE capability WHEN 'arity_robustness' THEN 1 WHEN 'structured_output' THEN 0 WHEN 'needle_in_tools' THEN n + 15 WHEN 'no_hallucinated_tool' THEN n - 1 ELSE n END AS INTEGER) AS n_tools
FROM t, c, (SELECT count(DISTINCT p_brand) AS n FROM part)
UNION ALL SELECT id, 'tool_restraint', NULL, CAST(n AS INTEGER) FROM (VALUES ('restraint_sum'), ('restraint_greeting'), ('restraint_capital')) r(id), (SELECT count(DISTINCT p_brand) AS n FROM part)
UNION ALL SELECT id, 'format_adherence', NULL, 0 FROM (VALUES ('format_yes'), ('format_ack')) f(id)"""
)
def battery_cross_product(spark, d):
    """The battery of a toolset: tools times templates."""
    return probes.derive(spark, _brand_tools(spark, d)).select("id", "capability", "expected_tool", F.size("tools").alias("n_tools"))


def _brand_tools(spark, d):
    names = [r[0] for r in table(spark, d, "part").select("p_brand").distinct().collect()]
    return [{"type": "function", "function": {"name": n, "description": f"Looks up {n}.", "parameters": {"type": "object", "properties": {"q": {"type": "string"}}}}} for n in names]


@query(
    """WITH t AS (SELECT DISTINCT p_brand AS name FROM part), offered AS (SELECT name FROM t UNION ALL SELECT 'filler_tool_' || lpad(CAST(k AS VARCHAR), 2, '0') FROM generate_series(0, 14) AS g(k))
SELECT 'needle_in_tools::' || t.name AS id, offered.name AS name, CAST(row_number() OVER (PARTITION BY t.name ORDER BY offered.name) AS INTEGER) AS place FROM t, offered"""
)
def needle_padding(spark, d):
    """The tools that each needle check offers, padding among them, in their order."""
    found = probes.derive(spark, _brand_tools(spark, d)).where("capability = 'needle_in_tools'")
    return found.select("id", F.posexplode("tools").alias("at", "t")).select("id", F.col("t.name").alias("name"), (F.col("at") + 1).alias("place"))


_BUCKET = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(id), ''), lambda h: CAST(strpos('0123456789abcdef', h) - 1 AS BIGINT))), lambda acc, h: (acc * 16 + h) % 1000)"


@query(
    f"""WITH n AS (SELECT p_name || '#' || CAST(p_partkey AS VARCHAR) AS id, p_brand FROM part), p AS (SELECT id, p_brand, {_BUCKET} AS b FROM n)
SELECT id, row_number() OVER (PARTITION BY p_brand ORDER BY b, id) <= floor(CASE p_brand WHEN 'Brand#11' THEN 0.67 WHEN 'Brand#12' THEN 0.33 ELSE 1.0 END * count(*) OVER (PARTITION BY p_brand) + 0.5) AS passes FROM p"""
)
def sim_pass_selection(spark, d):
    """Which probes the simulated model passes: the lowest hash buckets, as many as the profile's rate asks for."""
    rates = spark.createDataFrame([("Brand#11", 0.67), ("Brand#12", 0.33)], "capability string, rate double")
    battery = table(spark, d, "part").select(F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("capability"))
    return simulate.passing(battery, rates).select("id", "passes")


@query()
def simulated_scorecard(spark, d):
    """Derive, simulate, score and aggregate. The check texts are ours, so there is no SQL form; tests hold every rate against the profile."""
    battery = probes.derive(spark, _part_tools(spark, d))
    rates = spark.createDataFrame([("tool_selection", 0.67), ("arg_validity", 0.5), ("tool_restraint", 0.34)], "capability string, rate double")
    scored = scoring.score(simulate.respond(simulate.passing(battery, rates)))
    samples = scored.select(F.col("id").alias("probe_id"), "capability", F.lit(0).alias("sample_no"), "score", F.lit(None).cast("string").alias("error"))
    return scoring.capability_scores(scoring.pass_rates(samples))


@query("SELECT p_brand AS name FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_tools(spark, d):
    return health.duplicates(table(spark, d, "part").select(F.col("p_brand").alias("name")))


_TOOLS = """
t AS (SELECT CASE WHEN p_partkey % 20 = 1 THEN 'twice' ELSE p_brand || '-' || CAST(p_partkey AS VARCHAR) END AS name, p_size % 3 AS kind FROM part)"""


def _toolset(spark, d):
    kinds = [json.dumps(x) for x in ({}, {"type": "object", "properties": {"size": {"type": "integer"}}}, {"type": "object", "properties": {"note": {"description": "anything"}}})]
    name = F.when(F.col("p_partkey") % 20 == 1, "twice").otherwise(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select(name.alias("name"), F.element_at(F.array(*map(F.lit, kinds)), F.col("p_size") % 3 + 1).alias("parameters"))


@query(
    f"""WITH {_TOOLS}
SELECT 'error' AS level, 'duplicate-tool' AS code, 'more than one tool is called ' || name AS message FROM t GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'warn', 'few-tools', 'only ' || CAST(count(*) AS VARCHAR) || ' tools: picking the right one proves little' FROM t HAVING count(*) < 3
UNION ALL SELECT 'warn', 'no-args', name || ' takes no arguments' FROM t WHERE kind = 0
UNION ALL SELECT 'warn', 'unconstrained-args', name || ' accepts any arguments' FROM t WHERE kind = 2"""
)
def toolset_health(spark, d):
    """All parts as a toolset."""
    return health.toolset_health(_toolset(spark, d))


@query(
    """WITH w AS (SELECT event_type AS tool, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts FROM events),
by_tool AS (SELECT tool, count(*) AS n, count(*) FILTER (k % 4 <> 0) AS stale FROM w GROUP BY 1)
SELECT 'warn' AS level, 'schema-drift' AS code, 'the schema of ' || tool || ' changed since ' || CAST(stale AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' checks' AS message FROM by_tool WHERE tool <> 'click' AND stale > 0
UNION ALL SELECT 'error', 'tool-removed', tool || ' is gone, but ' || CAST(n AS VARCHAR) || ' checks use it' FROM by_tool WHERE tool = 'click'"""
)
def schema_drift(spark, d):
    """Checks against live schemas: one tool is gone, and three in four checks were recorded with another schema."""
    live_schema, old = json.dumps({"type": "object", "required": ["a", "b"]}), {0: json.dumps({"required": ["b", "a"], "type": "object"})}
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    e = table(spark, d, "events")
    live = e.select(F.col("event_type").alias("name")).where("event_type <> 'click'").distinct().withColumn("parameters", F.lit(live_schema))
    frozen = e.select(F.col("event_type").alias("tool"), F.when(k % 4 == 0, F.lit(old[0])).otherwise(F.concat(F.lit('{"maximum": '), k.cast("string"), F.lit("}"))).alias("schema"))
    return health.drift(live, frozen)


@query("SELECT event_id, substr(md5(props), 1, 8) AS response FROM events")
def request_memo(spark, d):
    """Equal requests are asked once: many recorded answers to a request, one for each check that makes it."""
    e = table(spark, d, "events")
    return scoring.answer(e.select("event_id", "props"), e.select("props", F.substring(F.md5("props"), 1, 8).alias("response")), ["props"]).select("event_id", "response")
