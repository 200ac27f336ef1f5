"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `min_match` tokens. The seeds of the benchmark are joined with those of each document; only pairs that share one can
have a tile, so the candidate search is exact. A candidate pair is tiled greedily: the longest common run of tokens that overlaps no
tile becomes a tile, again and again, found by running Karp-Rabin over shrinking lengths. Tiles may come in any order, so a passage whose
parts were moved is still covered. An item is found in a document when its tiles cover `threshold` of the item's tokens.

Scale: the benchmark is the side that is sent to the executors, after its size is summed; where it is larger than `chunk_bytes` it is cut
into parts by a hash of the item, and each part passes over the documents. The documents are never shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import grams, map_arrow, slices, utf8, whole, words

MIN_MATCH, THRESHOLD, CHUNK_BYTES = 5, 0.5, 32 << 20


def tiles(item: list, text: list, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first, ties by position in item, then in text.

    Each pass indexes the free runs of text of the current length by hash, extends what the item shares to maximal matches, and marks
    them longest first; what is left of a match that a tile cut is tried again. Then the length shrinks, down to min_match.
    """
    free_i, free_t = [True] * len(item), [True] * len(text)
    found: list[tuple[int, int, int]] = []

    def clear(a: list, b: list, i: int, j: int) -> bool:
        return a[i] and b[j] and item[i] == text[j]

    size = max(min_match, min(len(item), len(text)))
    while True:
        index: dict[int, list[int]] = {}
        for j, key in _rolling(text, free_t, size):
            index.setdefault(key, []).append(j)
        heap: list[tuple[int, int, int]] = []
        for i, key in _rolling(item, free_i, size):
            for j in index.get(key, ()):
                if i and j and clear(free_i, free_t, i - 1, j - 1):
                    continue  # part of a match that began earlier
                n = 0
                while i + n < len(item) and j + n < len(text) and clear(free_i, free_t, i + n, j + n):
                    n += 1
                if n >= size:
                    heapq.heappush(heap, (-n, i, j))
        while heap:
            n, i, j = heapq.heappop(heap)
            n = -n
            k = 0
            pieces = []
            while k < n:  # the parts that no tile has taken meanwhile
                if not (free_i[i + k] and free_t[j + k]):
                    k += 1
                    continue
                start = k
                while k < n and free_i[i + k] and free_t[j + k]:
                    k += 1
                pieces.append((start, k - start))
            if pieces == [(0, n)]:
                for k in range(n):
                    free_i[i + k] = free_t[j + k] = False
                found.append((i, j, n))
            else:
                for start, left in pieces:
                    if left >= size:
                        heapq.heappush(heap, (-left, i + start, j + start))
        if size <= min_match:
            return found
        size = max(min_match, size // 2)


def _rolling(tokens: list, free: list, size: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of each run of so many free tokens."""
    mod, base = (1 << 61) - 1, 0x1F3D5B79
    out = pow(base, size, mod)
    value = run = 0
    for k, token in enumerate(tokens):
        if not free[k]:
            value = run = 0
            continue
        run += 1
        value = (value * base + token) % mod
        if run > size:
            value = (value - tokens[k - size] * out) % mod
        if run >= size:
            yield k - size + 1, value


@dataclass
class Index:
    """The benchmark's seeds, sorted, each with the items that have it."""

    ids: list
    tokens: list[list[int]]
    seeds: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    min_match: int

    @classmethod
    def of(cls, rows: list[Row], min_match: int) -> Index:
        ids = [r[0] for r in rows]
        hashes, first, *_ = words(*utf8(pa.array([r[1] for r in rows], pa.string()), lower=True))
        ok = whole(first, min_match, len(hashes))
        seeds = grams(hashes, min_match)[ok]
        owner = np.repeat(np.arange(len(ids)), np.diff(first))[: len(ok)][ok]
        order = np.lexsort((owner, seeds))
        seeds, owner = seeds[order], owner[order]
        uniq, starts = np.unique(seeds, return_index=True)
        return cls(ids, [hashes[a:b].tolist() for a, b in zip(first[:-1], first[1:])], uniq, np.append(starts, len(seeds)), owner, min_match)

    def matches(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, coverage, tokens covered, tiles) of every pair that shares a seed."""
        if not len(self.seeds):
            return
        m = self.min_match
        for a, b in slices(offs):
            hashes, first, *_ = words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            seeds = grams(hashes, m)
            at = np.searchsorted(self.seeds, seeds)
            at[at == len(self.seeds)] = 0
            hit = np.flatnonzero((self.seeds[at] == seeds) & whole(first, m, len(hashes))) if len(seeds) else at
            rows = np.searchsorted(first, hit, "right") - 1
            for row in np.unique(rows):
                own = hit[rows == row]
                # A tile is made of seeds that match, so it lies within a run of matching seeds; the rest of the text can't matter.
                text: list[int] = []
                last = None
                for p in own.tolist():
                    if last is None or p >= last:
                        text += [-1] * (last is not None)
                        text += hashes[p : p + m].tolist()
                    else:
                        text += hashes[last : p + m].tolist()
                    last = p + m
                shared = np.unique(np.concatenate([self.items[self.starts[k] : self.starts[k + 1]] for k in np.unique(at[own])]))
                for k in shared.tolist():
                    item = self.tokens[k]
                    got = tiles(item, text, m)
                    covered = sum(n for _, _, n in got)
                    yield a + int(row), k, covered / len(item), covered, len(got)


def _parts(benchmark: DataFrame, chunk_bytes: int, min_match: int) -> Iterator[Index]:
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // chunk_bytes)
    for k in range(parts):
        yield Index.of(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect() if parts > 1 else items.collect(), min_match)


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Which documents hold which benchmark items: (doc_id, item_id, n_covered, n_tiles, coverage).

    Letter case and punctuation don't count. A null or empty text, and an item of fewer than min_match tokens, matches nothing. Rows that
    repeat a document or an item give one row for a pair of ids, the best covered. A null id is kept as such. No rows where either table
    is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind}, n_covered int, n_tiles int, coverage double"
    found = spark.createDataFrame([], schema)
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    for index in _parts(benchmark, chunk_bytes, min_match):
        shared = spark.sparkContext.broadcast(index)

        def detect(batches, shared=shared):
            own = shared.value
            for batch in batches:
                got = [x for x in own.matches(*utf8(batch.column(1), lower=True)) if x[2] >= threshold]
                ids = batch.column(0)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([x[0] for x in got], pa.int64())), pa.array([own.ids[x[1]] for x in got], id_type), pa.array([x[3] for x in got], pa.int32()), pa.array([x[4] for x in got], pa.int32()), pa.array([x[2] for x in got], pa.float64())],
                    ["doc_id", "item_id", "n_covered", "n_tiles", "coverage"],
                )

        found = found.unionByName(map_arrow(docs.select("doc_id", "text"), detect, schema))
    best = F.max(F.struct("coverage", "n_covered", "n_tiles")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_covered", "best.n_tiles", "best.coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose text covers no benchmark item. Decided row by row, so nothing is shuffled.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark takes nothing away.
    """
    where = docs.columns.index("text")
    for index in _parts(benchmark, chunk_bytes, min_match):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, shared=shared):
            for batch in batches:
                bad = {x[0] for x in shared.value.matches(*utf8(batch.column(where), lower=True)) if x[2] >= threshold}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

        docs = map_arrow(docs, keep, docs.schema)
    return docs
