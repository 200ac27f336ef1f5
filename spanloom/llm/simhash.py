"""Near duplicates by SimHash with Golay-code fuzzy hashing.

Each text gets a fingerprint of 92 bits: the sign of the sum of the random +-1 vectors of its distinct tokens, in lower case. It is cut into four segments of 23
bits. The perfect binary Golay code [23, 12, 7] has a codeword within distance 3 of any word, so two segments that differ in two bits or
fewer both lie within distance 4 of the codeword nearest to a midpoint. A segment's keys are therefore all codewords within distance 4: one
for the 277 syndromes of weight up to 2, six for the other 1771, 5.3 on average.

Two fingerprints that differ in `distance` <= 8 bits have at least two segments with two errors or fewer (three worse ones would make 9),
so a key made of two segments' codewords finds the pair for certain; up to 12 bits, the default, a pair is found with probability above
0.94 at 12 and 0.97 at 11, as tests hold. Each fingerprint takes part under every key of every pair of segments, 168 on average, with
no cap; candidates are verified by Hamming distance.

Scale: equal fingerprints are one node from the start. Rows meet by key in one shuffle; inside a key, fingerprints are compared with numpy and
only a spanning forest of the close ones is returned, so a bucket of m copies sends m - 1 edges on, not m squared. A random pair of
fingerprints shares a key with probability 3e-4; `segments_per_key` = 3 lowers that to 1e-6 at 596 keys each, with certainty up to 5 bits.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, back, cut, map_arrow, mix, named, slices, utf8, words
from .graph import components

DISTANCE, SEGMENTS, WIDTH, SEGMENTS_PER_KEY = 12, 4, 23, 2
BROADCAST_ROWS = 1_000_000
_GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def syndrome(word: np.ndarray) -> np.ndarray:
    """The remainder modulo the generator polynomial of the Golay code."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= ((word >> bit) & 1) * (_GENERATOR << (bit - 11))
    return word


@cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight up to 4, and how many there are (1 or 6)."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(x) for x in itertools.combinations([1 << k for k in range(WIDTH)], weight)], np.int64)
        for p, s in zip(patterns.tolist(), syndrome(patterns).tolist()):
            found[s].append(p)
    count = np.array([len(x) for x in found])
    return np.array([x + x[:1] * (6 - len(x)) for x in found]), count


@cache
def _remainders() -> np.ndarray:
    return syndrome(np.arange(1 << WIDTH, dtype=np.int64)).astype(np.int16)


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 indices of codewords within distance 4, how many of them count). A code word's index is its upper 12 bits."""
    patterns, count = _errors()
    s = _remainders()[segment]
    return (segment[:, None] ^ patterns[s]) >> 11, count[s]


def fingerprint(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits 0-45, bits 46-91, distinct tokens) of each row; a row without tokens has zeros."""
    n = len(offs) - 1
    low, high, count = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    weights = np.int64(1) << np.arange(2 * WIDTH, dtype=np.int64)
    for a, b in slices(offs):
        hashes, first, *_ = words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        rows = np.repeat(np.arange(a, b), np.diff(first))
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[new], rows[new]
        if not len(rows):
            continue
        at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        raw = np.stack([mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), mix(hashes ^ np.uint64(0x14057B7EF767814F))], 1).view(np.uint8)[:, :12]
        ones = np.add.reduceat(np.unpackbits(raw, axis=1, count=2 * 2 * WIDTH), at, axis=0, dtype=np.int32)
        own = np.diff(np.append(at, len(rows)))
        bits = (2 * ones > own[:, None]).astype(np.int64)
        where = rows[at]
        low[where], high[where], count[where] = bits[:, : 2 * WIDTH] @ weights, bits[:, 2 * WIDTH :] @ weights, own
    return low, high, count


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tid = hash of the text, low, high) of every row that has a token."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tid bigint, low bigint, high bigint"

    def run(batches):
        for batch in batches:
            low, high, count = fingerprint(*utf8(batch.column(2), lower=True))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low), pa.array(high)], ["doc_id", "tid", "low", "high"])
            yield out.filter(pa.array(count > 0))

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("tid"), "text"), run, schema)


def keys(nodes: DataFrame, per_key: int = SEGMENTS_PER_KEY) -> DataFrame:
    """(key, node, low, high): a row for each choice of segments and of one codeword for each of them."""

    def run(batches):
        for batch in batches:
            low, high = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            mask = (1 << WIDTH) - 1
            coded = [codewords(x) for x in (low & mask, low >> WIDTH, high & mask, high >> WIDTH)]
            for k, chosen in enumerate(itertools.combinations(range(SEGMENTS), per_key)):
                for picks in itertools.product(range(6), repeat=per_key):
                    use = np.ones(len(low), bool)
                    key = np.full(len(low), k, np.int64)
                    for segment, pick in zip(chosen, picks):
                        index, count = coded[segment]
                        use &= count > pick
                        key = key << 12 | index[:, pick]
                    at = pa.array(np.flatnonzero(use))
                    yield pa.RecordBatch.from_arrays([pa.array(key).take(at), *(batch.column(c).take(at) for c in range(3))], ["key", "node", "low", "high"])

    return map_arrow(nodes.select("node", "low", "high"), run, "key bigint, node bigint, low bigint, high bigint")


def _apart(low: np.ndarray, high: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(low[i] ^ low[j]).astype(np.int16) + np.bitwise_count(high[i] ^ high[j])


def _forest(low: np.ndarray, high: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of close pairs: each node is compared with those not reached yet."""
    rest, edges = np.arange(len(low)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _apart(low, high, x, rest) <= distance
            found = rest[near].tolist()
            edges += [(x, y) for y in found]
            queue += found
            rest = rest[~near]
    return edges


def close_pairs(keyed: DataFrame, distance: int = DISTANCE, large: int = 48) -> DataFrame:
    """(a, b): pairs of nodes under one key at no more than that distance; of a key with over `large` nodes, a spanning forest of them."""

    def link(key, node, low, high):
        a, b = [], []
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        few = np.repeat(sizes <= large, sizes)
        at, step = np.flatnonzero(few), 1
        while True:
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            near = at[_apart(low, high, at, at + step) <= distance]
            a.append(node[near])
            b.append(node[near + step])
            step += 1
        for s, n in zip(starts[sizes > large].tolist(), sizes[sizes > large].tolist()):
            got = np.array(_forest(low[s : s + n], high[s : s + n], distance), np.int64).reshape(-1, 2)
            a.append(node[s + got[:, 0]])
            b.append(node[s + got[:, 1]])
        a, b = np.concatenate(a or [node[:0]]), np.concatenate(b or [node[:0]])
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy() for k in range(4)]
            held.append(now)
            if now[0][0] != now[0][-1] or len(held) > 1 and held[0][0][0] != now[0][-1]:
                cols = [np.concatenate([h[k] for h in held]) for k in range(4)]
                stop = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
                yield link(*(c[:stop] for c in cols))
                held = [[c[stop:] for c in cols]]
        if held:
            yield link(*(np.concatenate([h[k] for h in held]) for k in range(4)))

    return map_arrow(keyed.repartition("key").sortWithinPartitions("key"), run, "a bigint, b bigint").distinct()


def groups(prints: DataFrame, distance: int = DISTANCE, per_key: int = SEGMENTS_PER_KEY) -> DataFrame:
    """(doc_id, tid, kept_doc_id, kept_tid) of every row of fingerprints() whose group of near duplicates has another row."""
    rows = prints.withColumn("node", F.xxhash64("low", "high"))
    nodes = rows.groupBy("node").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    roots = components(close_pairs(keys(nodes, per_key), distance))
    placed = rows.join(roots, "node", "left").select("doc_id", "tid", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("kept")
    kept = placed.groupBy("root").agg(F.count("*").alias("n"), first).where("n > 1")
    return placed.join(kept, "root").select("doc_id", "tid", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.tid").alias("kept_tid"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, per_key: int = SEGMENTS_PER_KEY) -> DataFrame:
    """(doc_id, kept_doc_id): each document that goes, with the one of its group that stays.

    A group is a connected component of pairs at no more than `distance`; its least doc_id stays (a null id only if all are null; ties by a
    hash of the text). Null texts and texts without a token are in no group. Of rows that repeat id and text one stays, so such an id
    is returned with itself. An empty table gives no rows. Other columns are not read.
    """
    found = groups(cut(fingerprints(docs)), distance, per_key)
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("tid") == F.col("kept_tid")))).select("doc_id", "kept_doc_id")
    again = found.where(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("tid") == F.col("kept_tid"))).groupBy("doc_id", "kept_doc_id").count().where("count > 1")
    return gone.distinct().unionByName(again.select("doc_id", "kept_doc_id")).distinct()


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE, per_key: int = SEGMENTS_PER_KEY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs, with all its columns, without the rows that near_duplicates() drops; of repeated rows one stays.

    The list of what goes has two numbers a row; it is broadcast if it has no more than broadcast_rows rows, and else joined by shuffle.
    """
    prints = cut(fingerprints(docs))
    found = cut(groups(prints, distance, per_key))
    same = F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("tid") == F.col("kept_tid"))
    gone = found.where(~same).select(F.col("doc_id").alias("__doc"), F.col("tid").alias("__tid")).distinct()
    repeats = found.where(same).groupBy("doc_id", "tid").count().where("count > 1")
    gone = cut(gone)
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    doc, tid = F.col(named(docs, "doc_id")), F.xxhash64(named(docs, "text"))
    out = aside(docs).join(side, doc.eqNullSafe(F.col("__doc")) & (tid == F.col("__tid")), "left_anti")
    if not repeats.isEmpty():
        out = out.withColumn("tid", tid)
        again = repeats.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), F.lit(True).alias("more"))
        marked = out.join(again, doc.eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t")), "left").drop("d", "t")
        nth = F.row_number().over(Window.partitionBy(doc, "tid").orderBy(F.lit(0)))
        out = marked.where("more IS NULL").unionByName(marked.where("more").withColumn("nth", nth).where("nth = 1").drop("nth"))
    return back(out, docs)
