r"""Secret scan with a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over trigrams that any match must contain: alternatives give OR, sequences AND, and
what can't be bounded gives "any". The index maps each trigram of the queries to the documents that contain it; a rule's postings are
intersected and united as its query says, and only the candidates are searched with the expression itself. A rule without a mandatory
trigram has the query "any", so all documents are its candidates.

Scale: the index is built a segment at a time, an Arrow batch, as search engines do, and used where it is built: texts never move, nothing is
shuffled, and every rule uses the one pass that finds trigrams. Rules are compiled ASCII-only, and trigrams are taken over lower-cased ASCII
bytes of UTF-8, so that case-insensitive rules need no variants.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices, utf8

RULES = {
    "access_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "assigned_secret": r"""(?i)\b(?:token|secret|api_key|password)\s{0,3}[=:]\s{0,3}(?:"[0-9a-z_+/=-]{16,100}"|'[0-9a-z_+/=-]{16,100}'|[0-9a-z_+/=-]{16,100}(?![0-9a-z_+/=-]*["']))""",
    "chat_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,72}",
    "cloud_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "forge_token": r"\bgh[pousr]_[0-9A-Za-z]{36}",
    "payment_key": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{24}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH |)PRIVATE KEY-----",
    "signed_web_token": r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "url_password": r"\b[a-z]{2,12}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@",
    "hex_digest_key": r"\b[0-9a-fA-F]{40}\b",
}
#: The rules of the SQL form, which has no upper-case, unquoted or single-quoted secrets of these two.
SQL_RULES = RULES | {
    "assigned_secret": r"""\b(?:token|secret|api_key|password)\s{0,3}[=:]\s{0,3}"[0-9A-Za-z_+/=-]{16,100}\"""",
    "hex_digest_key": r"\b[0-9a-f]{40}\b",
}

ANY = True
_MOST = 64


def _all(a, b):
    return b if a is ANY else a if b is ANY else ("and", a, b) if a != b else a


def _either(queries: list):
    if not queries or any(q is ANY for q in queries):
        return ANY
    out = queries[0]
    for q in queries[1:]:
        out = ("or", out, q) if q != out else out
    return out


def _trigrams(strings: set[bytes]):
    """What a text must contain if it contains one of the strings."""
    each = []
    for s in sorted(strings):
        q = ANY
        for k in range(len(s) - 2):
            q = _all(q, s[k : k + 3])
        each.append(q)
    return _either(each)


def _chars(items: list) -> set[bytes] | None:
    """A small character class as strings, or None."""
    out: set[bytes] = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(chr(arg).lower().encode() if arg < 128 else chr(arg).encode())
        elif op is K.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower().encode() if c < 128 else chr(c).encode() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(node) -> tuple[set[bytes] | None, object]:
    """(the strings that the node matches, if they are few, else None; the query that any match satisfies)."""
    now: set[bytes] = {b""}
    exact, query = True, ANY

    def flush() -> None:
        nonlocal now, query
        query = _all(query, _trigrams(now))
        now = {b""}

    for op, arg in node:
        own: set[bytes] | None = None
        more = ANY
        if op is K.LITERAL:
            own = _chars([(op, arg)])
        elif op is K.IN:
            own = _chars(arg)
        elif op is K.SUBPATTERN:
            own, more = _walk(arg[3])
        elif op is K.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                own = set().union(*(p[0] for p in parts))
            more = _either([p[1] if p[0] is None else _trigrams(p[0]) for p in parts])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, what = arg
            inner, q = _walk(what)
            if inner is not None and (low, high) == (0, 1):
                own = inner | {b""}
            elif inner is not None and low == high and low <= 4 and len(inner) ** low <= _MOST:
                own = {b""}
                for _ in range(low):
                    own = {a + b for a in own for b in inner}
            elif low >= 1:
                more = q if inner is None else _trigrams(inner)
        elif op is K.AT:
            own = {b""}
        elif op is K.ATOMIC_GROUP:
            own, more = _walk(arg)
        # anything else (look-around, references, any character) asks for nothing
        if own is not None and len(own) * len(now) <= _MOST:
            now = {a + b for a in now for b in own}
        elif own is not None:
            flush()
            exact, now = False, own if len(own) <= _MOST else {b""}
        else:
            flush()
            exact, query = False, _all(query, more)
    if exact:
        return now, ANY
    flush()
    return None, query


def trigram_query(pattern: str):
    """The Boolean query of a regular expression: ANY, a trigram, or ("and" | "or", query, query)."""
    exact, query = _walk(_parser.parse(pattern, re.ASCII))
    return query if exact is None else _trigrams(exact)


def _leaves(query) -> set[bytes]:
    return set() if query is ANY else {query} if isinstance(query, bytes) else _leaves(query[1]) | _leaves(query[2])


def evaluate(query, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """The documents that satisfy a query, in order."""
    if query is ANY:
        return everything
    if isinstance(query, bytes):
        return postings[query]
    a, b = evaluate(query[1], postings, everything), evaluate(query[2], postings, everything)
    return np.intersect1d(a, b, assume_unique=True) if query[0] == "and" else np.union1d(a, b)


class Scanner:
    """Rules, their queries, and the trigrams to index."""

    def __init__(self, rules: dict[str, str]):
        self.rules = {name: re.compile(p, re.ASCII) for name, p in rules.items()}
        self.queries = {name: trigram_query(p) for name, p in rules.items()}
        grams = sorted(set().union(*map(_leaves, self.queries.values())) if rules else set())
        self.grams = grams
        self.codes = np.array([g[0] << 16 | g[1] << 8 | g[2] for g in grams], np.int64)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True
        self.heads = np.zeros(1 << 16, bool)
        self.heads[self.codes >> 8] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, buf: np.ndarray, offs: np.ndarray) -> dict[bytes, np.ndarray]:
        """The inverted index of a segment, for the trigrams of the queries."""
        rows: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        for a, b in slices(offs):
            low = self.lower[buf[offs[a] : offs[b]]]
            if len(low) < 3:
                continue
            head = low[:-2].astype(np.uint16) << 8 | low[1:-1]
            at = np.flatnonzero(self.heads[head])
            code = head[at].astype(np.int64) << 8 | low[at + 2]
            keep = self.wanted[code]
            at, code = at[keep], code[keep]
            row = np.searchsorted(offs[a : b + 1] - offs[a], at, "right") - 1
            inside = at + 3 <= offs[a + row + 1] - offs[a]
            rows.append(row[inside] + a)
            codes.append(code[inside])
        if not rows:
            return {g: np.zeros(0, np.int64) for g in self.grams}
        pairs = np.unique(np.concatenate(codes) << 32 | np.concatenate(rows))
        edges = np.searchsorted(pairs, np.stack([self.codes << 32, self.codes + 1 << 32]))
        return {g: pairs[i:j] & 0xFFFFFFFF for g, i, j in zip(self.grams, *edges.tolist())}

    def scan(self, column: pa.Array) -> Iterator[tuple[int, str, int, str]]:
        """(row, rule, place among the rule's matches in the row, match)."""
        buf, offs = utf8(column)
        everything = np.arange(len(column))
        index = self.postings(buf, offs)
        texts: dict[int, str] = {}
        for name, pattern in self.rules.items():
            for row in evaluate(self.queries[name], index, everything).tolist():
                text = texts.get(row)
                if text is None:
                    text = texts[row] = bytes(buf[offs[row] : offs[row + 1]]).decode()
                for k, match in enumerate(pattern.finditer(text)):
                    yield row, name, k, match.group()


def secrets(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, rule, occurrence, n_chars, sha256) of every match of every rule in every text; the secret itself isn't returned.

    Matches of one rule don't overlap; those of two rules may. Null and empty texts match nothing. Repeated rows are each scanned and each
    reported. A null id is kept. An empty table, or no rules, gives no rows. Other columns are not read.
    """
    scanner_rules = RULES if rules is None else rules

    def run(batches):
        scanner = Scanner(scanner_rules)
        for batch in batches:
            got = [*scanner.scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([x[0] for x in got], pa.int64())), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.int64()), pa.array([len(x[3]) for x in got], pa.int64()), pa.array([hashlib.sha256(x[3].encode()).hexdigest() for x in got], pa.string())],
                ["doc_id", "rule", "occurrence", "n_chars", "sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, rule string, occurrence bigint, n_chars bigint, sha256 string")


def oracle(rules: dict[str, str] | None = None) -> str:
    """DuckDB SQL for op3_secrets: every rule over every text. Without rules it is that of SQL_RULES, so its rows are some of the query's."""
    each = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}') AS found FROM documents" for name, p in (SQL_RULES if rules is None else rules).items())
    return f"""
SELECT doc_id, rule, CAST(k - 1 AS BIGINT) AS occurrence, CAST(length(found[k]) AS BIGINT) AS n_chars, sha256(found[k]) AS sha256
FROM ({each}), generate_series(1, len(found)) AS g(k)
"""
