"""Queries over text and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining
from .base import EXCHANGES_SQL, exchanges, norm_sql, query, table


@query(f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def norm_text_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.norm_text(F.col("text")).alias("norm"))


@query(f"SELECT conv_id, turn, {norm_sql('text')} AS norm FROM conversations")
def norm_text_turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.norm_text(F.col("text")).alias("norm"))


@query("SELECT event_id, json_valid(props) AND json_type(props) = 'OBJECT' AS is_object, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json(props) AS VARCHAR) AS canonical FROM events")
def args_parse(spark, d):
    """Arguments parsed once; k stays typed."""
    e = table(spark, d, "events").select("event_id", "props")
    return e.select("event_id", T.json_object(F.col("props")).isNotNull().alias("is_object"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), T.canonical_json(F.col("props")).alias("canonical"))


@query(
    f"""WITH n AS (SELECT doc_id, {norm_sql('text')} AS norm FROM documents)
SELECT substr(sha256(norm), 1, 16) AS context_key, count(*) AS members, min(doc_id) AS representative FROM n GROUP BY 1"""
)
def exact_dedup_clusters(spark, d):
    n = table(spark, d, "documents").select("doc_id", T.hash_text(T.norm_text(F.col("text"))).alias("context_key"))
    return n.groupBy("context_key").agg(F.count("*").alias("members"), F.min("doc_id").alias("representative"))


@query(
    f"""WITH {EXCHANGES_SQL},
j AS (SELECT conv_id, at_turn, '{{"messages": [' || array_to_string(list_transform(saids, lambda s, k: '{{"content": ' || CAST(to_json(s) AS VARCHAR) || ', "role": ' || CAST(to_json(roles[k]) AS VARCHAR) || '}}'), ', ') || '], "tools": [{{"a": [1, 2], "name": "x,y:z"}}]}}' AS text FROM ex),
n AS (SELECT *, length(text) + 5 * length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) + 6 * length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) AS chars FROM j)
SELECT conv_id, at_turn, CAST(chars // 4 AS INTEGER) AS tokens, CASE WHEN at_turn % 5 = 4 THEN 'forced_tool_choice' WHEN chars // 4 > 512 THEN 'over_token_cap' END AS reason FROM n"""
)
def token_cap_filter(spark, d):
    """What can be mined: no forced choices, no contexts beyond the cap."""
    raw = F.transform("messages", lambda m: F.struct(F.to_json(F.struct(m["said"].alias("content"), m["role"].alias("role"))).alias("raw")))
    tools = F.array(F.struct(F.lit('{"a":[1,2],"name":"x,y:z"}').alias("raw")))
    rows = exchanges(spark, d).select("conv_id", F.col("at").alias("at_turn"), raw.alias("messages"), tools.alias("tools"), F.when(F.col("at") % 5 == 4, "required").otherwise("auto").alias("tool_choice"))
    marked = mining.filter_mineable(rows, mining.Config(max_context_tokens=512))
    return marked.select("conv_id", "at_turn", mining.context_tokens(F.col("messages"), F.col("tools")).alias("tokens"), F.col("skip_reason").alias("reason"))


def _scrub_sql(column: str, names: list[str]) -> str:
    for n in names:
        column = f"regexp_replace({column}, '{T.PATTERNS[n]}', '<{n[:-1]}>', 'g')"
    return column


def _redact(names: list[str]):
    def run(spark, d):
        return table(spark, d, "documents").select("doc_id", T.scrub(F.col("text"), names).alias("scrubbed"))

    return run


for _name, _patterns in (("redact_emails", ["emails"]), ("redact_phones", ["phones"]), ("redact_paths", ["paths"]), ("redact_all", ["emails", "phones", "paths"])):
    _f = _redact(_patterns)
    _f.__name__ = _name
    query(f"SELECT doc_id, {_scrub_sql('text', _patterns)} AS scrubbed FROM documents")(_f)


@query(f"SELECT url, {_scrub_sql('url', ['paths'])} AS scrubbed FROM pages")
def redact_page_paths(spark, d):
    return table(spark, d, "pages").select("url", T.scrub(F.col("url"), ["paths"]).alias("scrubbed"))


@query("SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 2 = 0 THEN ' <think>' || role || chr(10) || 'x</think> ' || text ELSE text END, '(?is)^" + T._SOME + "<think>.*?</think>" + T._SOME + "', '') AS answer FROM conversations")
def strip_think_block(spark, d):
    thought = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" <think>"), "role", F.lit("\nx</think> "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_think(thought).alias("answer"))


@query("SELECT conv_id, turn, replace(text, 'the', '[REDACTED]') AS redacted FROM conversations")
def redact_secret(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.redact_secret(F.col("text"), "the").alias("redacted"))


_PAYLOAD = "CASE event_id % 5 WHEN 0 THEN '{\"error\": \"' || event_type || '\"}' WHEN 1 THEN 'Error: ' || props WHEN 2 THEN '{\"errors\": []}' WHEN 3 THEN 'no errors here' ELSE props END"


@query(
    f"""WITH p AS (SELECT event_id, {_PAYLOAD} AS content FROM events)
SELECT event_id, CASE WHEN json_valid(content) THEN coalesce(json_extract_string(content, '$.error') <> '', false) ELSE regexp_matches(content, '(?i)^{T._SOME}(error|exception|traceback)\\b') END AS is_error FROM p"""
)
def error_payload_flag(spark, d):
    return table(spark, d, "events").select("event_id", T.looks_like_error(F.expr(_PAYLOAD)).alias("is_error"))


@query(
    """WITH u AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS a FROM conversations WHERE role = 'user'),
t AS (SELECT list_distinct(flatten(list(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9_]+')))) AS b FROM part)
SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS overlap FROM u, t"""
)
def lexical_overlap(spark, d):
    """User tokens that some part's text has, by a join with the distinct tokens of all parts."""
    words = table(spark, d, "part").select(F.explode(T.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("token")).distinct()
    u = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    each = u.select("text").distinct().select("text", F.explode(T.tokens(F.col("text"))).alias("token"))
    found = each.join(words, "token", "left_semi").groupBy(F.col("text").alias("said")).agg(F.count("*").alias("n"))
    own = F.size(T.tokens(F.col("text")))
    share = F.when(own == 0, F.lit(1.0)).otherwise(F.coalesce("n", F.lit(0)) / own)
    return u.join(found, F.col("text") == F.col("said"), "left").select("conv_id", "turn", share.alias("overlap"))


_MODELS = [(1, "Qwen2.5-7B-Instruct-Q4_K_M", "q4_k_m", "llama"), (2, "qwen3.5-9b-mlx", "", "mlx"), (3, "gemma3", None, None), (4, "Llama-3-8b-gguf-awq-int8", "int8", "vllm"), (5, "q4-model-fp16", None, "cuda"), (6, " lfm2.5-thinking-1.2b ", "f16", "onnx")]
_VALUES = ", ".join("(%d, '%s', %s, %s)" % (k, m, f"'{q}'" if q is not None else "NULL", f"'{r}'" if r is not None else "NULL") for k, m, q, r in _MODELS)


@query(
    f"""WITH m(id, model, quant, runtime) AS (VALUES {_VALUES}), s AS (SELECT *, string_split(lower(trim(model)), '-') AS p FROM m)
SELECT id, array_to_string(list_concat(p[1:1], list_filter(p[2:], lambda t: NOT (regexp_matches(t, '{T.QUANT}') OR t IN ({", ".join(f"'{r}'" for r in T.RUNTIMES)}) OR t = coalesce(lower(trim(quant)), '') OR t = coalesce(lower(trim(runtime)), '')))), '-') AS family FROM s"""
)
def model_family(spark, d):
    m = spark.createDataFrame(_MODELS, "id int, model string, quant string, runtime string")
    return m.select("id", T.model_family(F.col("model"), F.col("quant"), F.col("runtime")).alias("family"))


@query("SELECT r_name AS grp, substr(sha256(string_agg(n_name, ',' ORDER BY n_name)), 1, 16) AS fingerprint FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def fingerprint(spark, d):
    """Hashes of sets, whatever their order."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("grp")).agg(T.fingerprint(F.col("n_name")).alias("fingerprint"))


@query("WITH f AS (SELECT substr(sha256(string_agg(n_name, ',' ORDER BY n_name)), 1, 16) AS a FROM nation), g AS (SELECT substr(sha256(string_agg(r_name, ',' ORDER BY r_name)), 1, 16) AS b FROM region) SELECT a AS tools, b AS traces, substr(sha256(a || '+' || b), 1, 16) AS combined FROM f, g")
def combined_fingerprint(spark, d):
    a = table(spark, d, "nation").agg(T.fingerprint(F.col("n_name")).alias("tools"))
    b = table(spark, d, "region").agg(T.fingerprint(F.col("r_name")).alias("traces"))
    return a.crossJoin(b).withColumn("combined", T.combined_fingerprint(F.col("tools"), F.col("traces")))


@query(
    """WITH a AS (SELECT vec_id AS a, CAST(embedding AS DOUBLE[]) AS va FROM embeddings), b AS (SELECT vec_id AS b, CAST(embedding AS DOUBLE[]) AS vb FROM embeddings)
SELECT a, b, round(list_cosine_similarity(va, vb), 6) AS cosine FROM a JOIN b ON a < b WHERE list_cosine_similarity(va, vb) >= 0.4"""
)
def cosine_pairs(spark, d):
    from ..operators.cluster import close_pairs

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    return close_pairs(v, 0.4).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(
    """WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
walk(i, ids, es, key, leader) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS DOUBLE[][]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT i, CASE WHEN at_ IS NULL OR at_ = 0 THEN list_append(ids, vec_id) ELSE ids END, CASE WHEN at_ IS NULL OR at_ = 0 THEN list_append(es, e) ELSE es END, vec_id, CASE WHEN at_ IS NULL OR at_ = 0 THEN vec_id ELSE ids[at_] END
  FROM (SELECT v.i AS i, w.ids AS ids, w.es AS es, v.vec_id AS vec_id, v.e AS e, list_position(list_transform(w.es, lambda x: list_cosine_similarity(x, v.e) >= 0.4), true) AS at_ FROM walk w JOIN v ON v.i = w.i + 1))
SELECT key, leader FROM walk WHERE key IS NOT NULL"""
)
def leader_clusters(spark, d):
    """Each vector joins the first leader in key order that is close enough."""
    from ..operators.cluster import near_clusters

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("context_key"), F.col("embedding").alias("vec"))
    return near_clusters(v, v, 0.4).select(F.col("context_key").alias("key"), F.col("cluster").alias("leader"))


@query("SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(p_name), ''), lambda h: CAST(strpos('0123456789abcdef', h) - 1 AS BIGINT))), lambda acc, h: (acc * 16 + h) % 1000) AS bucket FROM part")
def hash_buckets(spark, d):
    """A 256-bit hash as a number, modulo 1000, folded digit by digit."""
    return table(spark, d, "part").select("p_partkey", T.hash_bucket(F.col("p_name")).cast("long").alias("bucket"))


