"""Substring dedup over sliding spans of sentences.

A text is cut after the marks . ! ? ; : , that a blank follows, after their wide forms, and after line ends: that is sentences, and the clauses of
long ones, as a passage that was pasted into a text seldom begins and ends with one of its sentences. A blank piece goes with the one before. Every run of consecutive pieces with
`min_chars` characters or more, blanks at their ends not counted, is a span. Of equal spans the first, by document and place, stays; every piece
that a later one covers is removed.

Not every run need be hashed. From each piece on the shortest run that is long enough, and up to each piece the shortest, suffice: a repeated run
is covered by such runs inside it, and they are repeated with it. That is two rows a piece at most, often one.

Scale: a task first drops, among so many runs as `CHUNK_RUNS`, those that an earlier one of the same chunk equals: they can't be the first anywhere, and
leave as merged stretches of their document. So a span that a third of all documents share sends a row a chunk to the shuffle, where a running
window over each hash finds the first. Five numbers a run are shuffled, never text; the texts move once more, only to lose their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, back, map_arrow, mix, named, powers, slices, unpowers, utf8

MIN_CHARS, CHUNK_RUNS = 120, 1 << 20
MARKS = ".!?;:,"
WIDE = "。！？；：，、"
_BLANK = " \n\r\t"

_MARK, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[*map(ord, MARKS)]] = True
_SPACE[[*map(ord, _BLANK)]] = True


def _edges(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces begin, with the end of the last: the rows' own edges and the places after marks."""
    n = len(buf)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    stop = np.flatnonzero(_MARK[buf[:-1]] & (buf[1:] == 32)) if n > 1 else np.zeros(0, np.int64)
    stop = stop[~first[stop + 1]] + 2  # the blank belongs to the same row
    cuts = [offs, stop, np.flatnonzero(buf == 10) + 1]
    for mark in map(str.encode, WIDE):
        at = np.flatnonzero(buf[: max(n - 2, 0)] == mark[0])
        cuts.append(at[(buf[at + 1] == mark[1]) & (buf[at + 2] == mark[2])] + 3)
    return np.unique(np.concatenate(cuts))


def runs(buf: np.ndarray, offs: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of the shortest runs from each piece on and up to each piece; places in bytes of the row."""
    edges = _edges(buf, offs)
    filled = np.flatnonzero(~_SPACE[buf])
    low, high = np.searchsorted(filled, edges[:-1]), np.searchsorted(filled, edges[1:])
    said = np.flatnonzero(high > low)  # pieces that aren't blank
    if not len(said):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    begin, end = filled[low[said]], filled[high[said] - 1] + 1
    row = np.searchsorted(offs, edges[said], "right") - 1
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    upto = np.concatenate([[0], np.cumsum(chars[end] - chars[begin])])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf))[: len(buf)])])
    own = mix((sums[end] - sums[begin]) * unpowers(len(buf))[begin])
    chain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * unpowers(len(own))[: len(own)])])
    each = np.arange(len(said))
    start_of, last_of = np.searchsorted(row, row), np.searchsorted(row, row, "right") - 1
    ahead = np.searchsorted(upto, upto[:-1] + min_chars) - 1
    ahead = np.maximum(ahead, each)
    behind = np.minimum(np.searchsorted(upto, upto[1:] - min_chars, "right") - 1, each)
    down = np.flatnonzero(ahead <= last_of)
    up = np.flatnonzero(behind >= start_of)
    up = up[ahead[behind[up]] != up]
    i, j = np.concatenate([down, behind[up]]), np.concatenate([ahead[down], up])
    hashes = mix((chain[j + 1] - chain[i]) * powers(len(own))[i] ^ mix((j - i + 1).astype(np.uint64)))
    until = np.minimum(np.append(edges[said[1:]], len(buf)), offs[row + 1])
    return row[i], edges[said[i]] - offs[row[i]], until[j] - offs[row[i]], hashes


def ranks(doc: pa.Array, tid: np.ndarray) -> np.ndarray:
    """A number for each (doc_id, hash of text), equal for equal ones, in their order, null ids last."""
    coded = doc.dictionary_encode(null_encoding="encode")
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.array_sort_indices(coded.dictionary, null_placement="at_end").to_numpy()] = np.arange(len(place))
    code = place[coded.indices.to_numpy()]
    order = np.lexsort((tid, code))
    new = np.append(False, (np.diff(code[order]) != 0) | (np.diff(tid[order]) != 0))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each owner that touch or overlap as one."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    far = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + owner * far) - owner * far  # owners rise, so an earlier one's reach can't count
    new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1]))[: len(owner)]
    at = np.flatnonzero(new)
    return owner[at], start[at], reach[np.append(at[1:], len(owner))[: len(at)] - 1]


def _chunk(docs: list[pa.Array], tids: list[np.ndarray], found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The first of equal runs of a chunk, and what the others cover."""
    doc, tid = pa.chunked_array(docs).combine_chunks(), np.concatenate(tids)
    row, start, end, h = (np.concatenate([f[k] for f in found]) for k in range(4))
    rank = ranks(doc, tid)
    some = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
    some[rank] = np.arange(len(rank))  # a row for each rank
    own = rank[row]
    order = np.lexsort((start, own, h))
    own, start, end, h = own[order], start[order], end[order], h[order]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    late = ~new & ((own != own[head]) | (start != start[head]))
    gone = merged(own[late], start[late], end[late])
    parts = [(h[new], own[new], start[new], end[new]), (mix(gone[0].astype(np.uint64) ^ tid[some[gone[0]]].view(np.uint64) ^ mix(gone[1].astype(np.uint64))), *gone)]
    for k, (key, who, a, b) in enumerate(parts):
        at = some[who]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), bool(k))), doc.take(pa.array(at)), pa.array(tid[at]), pa.array(a), pa.array(b)], ["h", "late", "doc_id", "tid", "start", "end"])


def _spans(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h, late, doc_id, tid, start, end): a row for each run that may be a first, and each stretch that is none (late)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ids, tids, found, rows, size = [], [], [], 0, 0
        for batch in batches:
            ids.append(batch.column(0))
            tids.append(batch.column(1).to_numpy())
            buf, offs = utf8(batch.column(2))
            for a, b in slices(offs):
                row, *rest = runs(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], min_chars)
                found.append((row + rows + a, *rest))
                size += len(row)
            rows += batch.num_rows
            if size >= CHUNK_RUNS:
                yield from _chunk(ids, tids, found)
                ids, tids, found, rows, size = [], [], [], 0, 0
        if size:
            yield from _chunk(ids, tids, found)

    rows = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tid"), "text")
    return map_arrow(rows, run, f"h bigint, late boolean, doc_id {kind}, tid bigint, start bigint, end bigint")


def repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, tid, cut): for each document with a later occurrence, the stretches to remove, in bytes, which don't touch."""
    order = Window.partitionBy("h", "late").orderBy(F.col("doc_id").asc_nulls_last(), "tid", "start")
    here = F.struct("doc_id", "tid", "start")
    ranked = _spans(docs, min_chars).select("*", F.row_number().over(order).alias("nth"), F.first(here).over(order).alias("first"))
    later = ranked.where(F.col("late") | (F.col("nth") > 1) & ~here.eqNullSafe(F.col("first"))).select("doc_id", "tid", "start", "end")
    own = Window.partitionBy("doc_id", "tid").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(own)
    whole = later.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "tid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))


def _shortened(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """aside(docs) with short, the text without what is to be removed."""
    doc, text = F.col(named(docs, "doc_id")), F.col(named(docs, "text"))
    side = found.withColumnsRenamed({"doc_id": "d", "tid": "t"})
    out = aside(docs).join(side, doc.eqNullSafe(F.col("d")) & (F.xxhash64(text) == F.col("t")), how)
    raw = text.cast("binary")
    begins, ends = F.concat(F.array(F.lit(0).cast("long")), F.col("cut.end")), F.concat(F.col("cut.start"), F.array(F.octet_length(text).cast("long")))
    kept = F.zip_with(begins, ends, lambda a, b: raw.substr((a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return out.withColumn("short", F.when(F.col("cut").isNull(), text).otherwise(F.array_join(kept, "")))


def shortened(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_chars, n_removed, text) of each document that loses something; n_chars is the length before.

    A document without a repeated run, a null and an empty text lose nothing. Occurrences are ordered by doc_id, nulls last, then by a hash of
    the text, then by place; what a document has twice is repeated too. Rows that repeat id and text are one document and lose the same. A text can
    become empty. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text")
    out = _shortened(rows, repeats(rows, min_chars), "inner")
    return out.select(F.col("__c0").alias("doc_id"), F.length("__c1").alias("n_chars"), (F.length("__c1") - F.length("short")).alias("n_removed"), F.col("short").alias("text"))


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, all rows and columns, each text without its repeated spans."""
    out = _shortened(docs, repeats(docs, min_chars), "left")
    return back(out, docs, text=F.col("short"))


def _cut_sql(text: str) -> str:
    for end in [f"'{m} '" for m in MARKS] + [f"'{m}'" for m in WIDE] + ["chr(10)"]:
        text = f"replace({text}, {end}, {end} || chr(1))"
    return text


def oracle(min_chars: int = MIN_CHARS) -> str:
    """DuckDB SQL for op9_sentence_spans. Runs are compared as lists of texts."""
    chars = "' ' || chr(10) || chr(13) || chr(9)"
    return f"""
WITH cut AS (SELECT doc_id, text, string_split({_cut_sql("text")}, chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
piece AS (SELECT doc_id, text, k - 1 AS k, parts[k] AS raw, trim(parts[k], {chars}) AS s, len(parts) AS parts FROM cut, generate_series(1, len(parts)) AS g(k)),
said AS (SELECT *, row_number() OVER w AS nth, sum(length(s)) OVER w AS upto, coalesce(lead(k) OVER w, parts) - 1 AS until_ FROM piece WHERE s <> '' WINDOW w AS (PARTITION BY doc_id, text ORDER BY k)),
pairs AS (
  SELECT a.doc_id AS doc_id, a.text AS text, a.nth AS i, b.nth AS j FROM said a JOIN said b
  ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text AND b.nth BETWEEN a.nth AND a.nth + {min_chars - 1} AND b.upto - a.upto + length(a.s) >= {min_chars}
     AND (b.upto - length(b.s) - a.upto + length(a.s) < {min_chars} OR b.upto - a.upto < {min_chars})),
own AS (
  SELECT p.doc_id AS doc_id, p.text AS text, p.i AS i, p.j AS j, min(s.k) AS begin_, max(s.until_) AS end_, list(s.s ORDER BY s.nth) AS run
  FROM pairs p JOIN said s ON p.doc_id IS NOT DISTINCT FROM s.doc_id AND p.text = s.text AND s.nth BETWEEN p.i AND p.j GROUP BY p.doc_id, p.text, p.i, p.j),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, begin_) AS nth FROM own) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, text, k FROM later, generate_series(begin_, end_) AS g(k)),
left_ AS (
  SELECT p.doc_id AS doc_id, p.text AS text, coalesce(string_agg(p.raw, '' ORDER BY p.k) FILTER (g.k IS NULL), '') AS short, bool_or(g.k IS NOT NULL) AS hit
  FROM piece p LEFT JOIN gone g ON g.doc_id IS NOT DISTINCT FROM p.doc_id AND g.text = p.text AND g.k = p.k GROUP BY p.doc_id, p.text)
SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(length(text) - length(short) AS INTEGER) AS n_removed, short AS text FROM left_ WHERE hit
"""
