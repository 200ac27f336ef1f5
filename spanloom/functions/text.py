"""Text and JSON as Column builders; all but norm_args stay inside the JVM.

White space, digits and letters are those of Unicode. Patterns spell their classes so that the JVM's engine and RE2 read them alike.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .shipping import ship

_BLANKS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\p{L}\p{N}_"
SPACE = f"[{_BLANKS}]+"
_SOME = f"[{_BLANKS}]*"
# Of a calendar day with a time of day and what may follow, of a day alone, of a time alone.
_STAMPS = (r"D{4}-DD-DD[T ]DD:DD(:DD(\.D+)?)?(Z|[+-]DD:?DD)?", r"\bD{4}-DD-DD\b", r"\bDD:DD:DD\b")
TIMESTAMP_RE2 = "|".join(_STAMPS).replace("D", r"\p{Nd}")
TIMESTAMP = TIMESTAMP_RE2.replace(r"\b", f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))")
PATTERNS = {
    "emails": f"[{_WORD}.+-]+@[{_WORD}-]+\\.[{_WORD}.-]+",
    "phones": f"\\+?\\p{{Nd}}[\\p{{Nd}}{_BLANKS}().-]{{5,}}\\p{{Nd}}",
    "paths": f"([A-Za-z]:)?[\\\\/]([{_WORD}.~-]+[\\\\/])+[{_WORD}.~-]+",
}
RUNTIMES = ("coreml", "cpu", "cuda", "ggml", "gguf", "hip", "metal", "mlx", "mps", "onnx", "rocm", "sycl", "tensorrt", "vllm", "vulkan")
QUANT = r"^(iq[0-9].*|q[0-9].*|(f|fp|bf|int)[0-9]+|awq|gptq)$"


def for_python(pattern: str) -> str:
    """One of the patterns above as Python's engine spells it."""
    return pattern.replace(_WORD, r"\w").replace(_BLANKS, r"\s").replace(r"\p{Nd}", r"\d")


_CLOCK = re.compile(for_python(TIMESTAMP_RE2))


def norm_value(x: Any) -> Any:
    """Every string of a JSON value without clock readings and with single blanks; keys stay."""
    if isinstance(x, str):
        return " ".join(_CLOCK.sub("<ts>", x).split())
    if isinstance(x, dict):
        return {k: norm_value(v) for k, v in x.items()}
    return [*map(norm_value, x)] if isinstance(x, list) else x


def norm_text(text: Column) -> Column:
    """Clock readings become <ts>, white space collapses, the ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, TIMESTAMP, "<ts>"), SPACE, " "))


def scrub(text: Column, patterns: list[str]) -> Column:
    """Replace matches by <name>, in the caller's order: later patterns see earlier placeholders."""
    unknown = set(patterns) - set(PATTERNS)
    if unknown:
        raise ValueError(f"unknown pattern: {', '.join(sorted(unknown))}")
    for name in patterns:
        text = F.regexp_replace(text, PATTERNS[name], f"<{name[:-1]}>")
    return text


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; null where it doesn't parse."""
    return F.to_json(F.try_parse_json(text))


def hash_text(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def _norm_args(text: str) -> str:
    try:
        value = json.loads(text)
    except ValueError:
        return norm_value(text)
    return json.dumps(norm_value(value), sort_keys=True, separators=(",", ":"))


def norm_args(arguments: Column) -> Column:
    """Arguments with normalized strings and sorted keys, or normalized text where they aren't JSON. Strings can be nested at any depth, which no
    expression reaches, so this runs in Arrow batches, a text at a time into Arrow's memory. Python objects are kept of short texts alone, as these
    repeat."""
    ship(SparkSession.active())

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        short: dict[str, str] = {}

        def one(t: str | None) -> str | None:
            if t is None or len(t) > 100:
                return None if t is None else _norm_args(t)
            if t not in short:
                short[t] = _norm_args(t)
            return short[t]

        parts = [pa.array([one(t.as_py()) for t in texts.slice(k, 100)], pa.string()) for k in range(0, len(texts), 100)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run(arguments)


def norm_args_each(arguments: Column) -> Column:
    """norm_args() of each text of an array; lambdas can't hold Python."""
    ship(SparkSession.active())

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda texts: None if texts is None else [None if t is None else _norm_args(t) for t in texts])

    return run(arguments)


def json_object(text: Column) -> Column:
    """The text as VARIANT if it is a JSON object, else null."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _truthy(value: Column) -> Column:
    kind, text = F.schema_of_variant(value), F.to_json(value)
    return value.isNotNull() & (kind != "VOID") & ~text.isin("false", '""', "{}", "[]", "0", "null")


def looks_like_error(content: Column) -> Column:
    """An object with a truthy error or errors, or text that opens like an error; other JSON and blank text isn't one."""
    parsed = F.try_parse_json(content)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    named = _truthy(F.try_variant_get(parsed, "$.error", "variant")) | _truthy(F.try_variant_get(parsed, "$.errors", "variant"))
    said = content.rlike(rf"(?i)^{_SOME}(error|exception|traceback)\b")
    blank = ~F.coalesce(content, F.lit("")).rlike(f"[^{_BLANKS}]")
    return F.when(blank, False).when(parsed.isNull(), said).otherwise(F.coalesce(is_object & named, F.lit(False)))


def strip_think(content: Column) -> Column:
    """Without one leading think block."""
    return F.regexp_replace(content, rf"(?is)^{_SOME}<think>.*?</think>{_SOME}", "")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), 0))


def overlap(user: Column, tools: Column) -> Column:
    """The share of the user's tokens that the tools' text has; 1 without user tokens."""
    own = tokens(user)
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, tokens(tools))) / F.size(own))


def model_family(model: Column, quant: Column, runtime: Column) -> Column:
    """The name without tokens that say how it is quantized or run; the first token always stays."""
    parts = F.split(F.lower(F.trim(model)), "-")
    q, r = (F.coalesce(F.lower(F.trim(c)), F.lit("")) for c in (quant, runtime))
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda t: ~(t.rlike(QUANT) | t.isin(*RUNTIMES) | (t == q) | (t == r)))
    return F.array_join(F.concat(F.slice(parts, 1, 1), rest), "-")


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    a, b = wide(a), wide(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).when(size == 0, F.lit(0.0)).otherwise(dot / F.when(size != 0, size))


def hash_bucket(text: Column, buckets: int = 1000) -> Column:
    """The SHA-256 of a text as one number, modulo buckets."""
    digits = F.split(F.sha2(text, 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("int")) % buckets)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the length of the text as ASCII JSON would spell it: a character beyond ASCII counts six, beyond the basic plane twelve."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    astral = F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10ffff}]", ""))
    return F.floor((F.length(text) + 5 * wide + 6 * astral) / 4).cast("int")


def redact_secret(text: Column, secret: str) -> Column:
    """A known secret out of a text; an empty secret changes nothing."""
    return F.replace(text, F.lit(secret), F.lit("[REDACTED]")) if secret else text


def combined_fingerprint(*marks: Column) -> Column:
    """One fingerprint of those that are there: none gives null, one is itself."""
    given = F.array_compact(F.array(*marks))
    return F.when(F.size(given) == 1, given[0]).when(F.size(given) > 1, hash_text(F.array_join(given, "+")))


def fingerprint(texts: Column, length: int = 16) -> Column:
    """Aggregate: a hash of a set of texts whatever their order."""
    return hash_text(F.array_join(F.array_sort(F.collect_list(texts)), ","), length)
