"""Clusters of near contexts by embedding: each key, in order, joins the first leader that is close enough, or leads.

Close pairs come from products of blocks of unit vectors. Vectors are ranged by their coordinate on the axis that spreads them most: unit vectors whose
cosine is c differ there by no more than sqrt(2 - 2c), so a vector meets only the blocks within that reach. Ranges that hold many vectors are split by
a hash, so that blocks stay of one size. Blocks grow with the table up to BLOCK_BYTES, as each vector is sent once a block that it meets, and are
multiplied in tiles, so that a task holds two blocks and a tile. Who leads is settled in rounds: an open key that no close open one precedes leads,
and keys that a leader precedes closely are open no more, nor are their pairs. Whom a key follows is then the least of the leaders close to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

BLOCK, TILE, BLOCK_BYTES = 2048, 1024, 1 << 24
#: Rows that a task puts into one batch.
ROWS = 20_000


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, unit) of (key, vec), without vectors whose length is zero or no number."""
    for batch in batches:
        vec = batch.column(1)
        sizes = vec.value_lengths().fill_null(0).to_numpy()
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            x = _matrix(vec.take(pa.array(at)))
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(1))
            good = (norm > 0) & (norm < np.inf)
            unit = x[good] / norm[good, None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[good])), pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, size), pa.int32()), pa.array(unit.ravel()))], ["key", "unit"])


def _axis(vectors: DataFrame, length: int) -> int:
    """The coordinate of the greatest variance; each task sends one row of sums."""

    def sums(batches):
        n, total = 0, np.zeros((2, length))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, total = n + len(x), total + np.stack([x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [total.ravel().tolist()]})

    got = vectors.select("unit").mapInArrow(sums, "n bigint, s array<double>").collect()
    n = max(1, sum(r["n"] for r in got))
    one, two = np.sum([np.array(r["s"]).reshape(2, -1) for r in got], axis=0) / n
    return int(np.argmax(two - one * one))


def _block(n: int, length: int) -> int:
    """Vectors a block: an eighth of them, so that shuffling follows the input, till a block is full."""
    full = max(256, BLOCK_BYTES // (8 * length))
    return min(full, max(BLOCK, -(-n // 8)))


def _pairs(vectors: DataFrame, length: int, threshold: float, block: int | None) -> DataFrame:
    axis = _axis(vectors, length)
    placed = vectors.withColumn("x", F.get("unit", F.lit(axis)))
    n = placed.count()
    block = block or _block(n, length)
    ranges = max(1, -(-n // block))
    cuts = placed.select(F.percentile_approx("x", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    edges = np.unique(np.array(cuts or [], float))

    def count(batches):
        total = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            total += np.bincount(np.searchsorted(edges, batch.column(0).to_numpy(), "right"), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"c": [total.tolist()]})

    sizes = np.sum([np.array(r["c"]) for r in placed.select("x").mapInArrow(count, "c array<bigint>").collect()], axis=0)
    split = np.maximum(1, -(-sizes // block)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(split)])
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def send(batches):
        step = max(1, ROWS // int(base[-1]))
        for batch in (whole.slice(k, step) for whole in batches for k in range(0, whole.num_rows, step)):
            x, h = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            r = np.searchsorted(edges, x, "right")
            own = base[r] + h % split[r]
            low, high = base[np.searchsorted(edges, x - reach, "right")], base[np.searchsorted(edges, x + reach, "right") + 1]
            times = high - low
            row = np.repeat(np.arange(len(x)), times)
            to = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own[row], to)), pa.array(np.maximum(own[row], to)), pa.array(own[row]), batch.column(0).take(take), batch.column(1).take(take)], ["p", "q", "own", "key", "unit"])

    kind = vectors.schema["key"].dataType.simpleString()
    sent = placed.select("key", "unit", "x", F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("h")).mapInArrow(send, f"p bigint, q bigint, own bigint, key {kind}, unit array<double>")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            p, q, own = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), batch.column(2).to_numpy()
            for side, at in zip(sides[: 1 + (p != q)], (p, q)):
                mine = np.flatnonzero(own == at)
                side.append((batch.column(3).take(pa.array(mine)), _matrix(batch.column(4))[mine]))
        same = p == q
        (u, x), (v, y) = ((pa.concat_arrays([k for k, _ in side]), np.concatenate([m for _, m in side])) for side in (sides[0], sides[0] if same else sides[1]))
        sides = ([], [])
        xs, ys = x.astype(np.float32), y.astype(np.float32)
        least = np.float32(threshold - 1e-5 - 2e-7 * length)  # single precision finds candidates, double precision decides
        found, n = [], 0
        for i in range(0, len(x), TILE):
            for j in range(i if same else 0, len(y), TILE):
                near = np.flatnonzero(xs[i : i + TILE] @ ys[j : j + TILE].T >= least)
                for k in range(0, len(near), ROWS):
                    a, b = np.divmod(near[k : k + ROWS], min(TILE, len(y) - j))
                    a, b = i + a, j + b
                    cosine = np.einsum("ij,ij->i", x[a], y[b])
                    keep = (cosine >= threshold) & ((a < b) | (not same))
                    found.append((a[keep], b[keep], cosine[keep]))
                    n += len(a)
                    if n >= ROWS:
                        yield _found(found, u, v)
                        found, n = [], 0
        if n:
            yield _found(found, u, v)

    met = sent.groupBy("p", "q").applyInArrow(product, f"u {kind}, v {kind}, cosine double")
    return met.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "cosine")


def _found(parts: list[tuple], u: pa.Array, v: pa.Array) -> pa.RecordBatch:
    a, b, cosine = map(np.concatenate, zip(*parts))
    return pa.RecordBatch.from_arrays([u.take(pa.array(a)), v.take(pa.array(b)), pa.array(cosine)], ["u", "v", "cosine"])


def close_pairs(vectors: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(a, b, cosine) with a < b of (key, vec), for a threshold above 0. Keys are distinct. Empty vectors, those of length zero and pairs of different
    length have a cosine of 0, so they are in no pair."""
    if not threshold > 0:
        raise ValueError("the threshold is above 0")
    ship(vectors.sparkSession)
    kind = vectors.schema["key"].dataType.simpleString()
    usable = _cut(vectors.select("key", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_units, f"key {kind}, unit array<double>"))
    lengths = sorted(r[0] for r in usable.select(F.size("unit")).distinct().collect())
    out = None
    for n in lengths:
        some = _pairs(usable.where(F.size("unit") == n), n, threshold, block)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cosine double")


def leaders(vectors: DataFrame, threshold: float) -> DataFrame:
    """(key, leader) of (key, vec). Equal vectors need no special case; keys are compared by their own order."""
    pairs = _cut(close_pairs(vectors, threshold).select("a", "b"))
    keys = _cut(vectors.select("key").distinct())
    open_, left, leads = keys, pairs, None
    while not open_.isEmpty():
        new = _cut(open_.join(left.select(F.col("b").alias("key")), "key", "left_anti"))
        gone = _cut(left.join(new.select(F.col("key").alias("a")), "a", "left_semi").select(F.col("b").alias("key")).distinct())
        leads = new if leads is None else leads.unionByName(new)
        open_ = _cut(open_.join(new.unionByName(gone), "key", "left_anti"))
        left = _cut(left.join(gone.select(F.col("key").alias("b")), "b", "left_anti").join(gone.select(F.col("key").alias("a")), "a", "left_anti").select("a", "b"))
    if leads is None:
        return keys.withColumn("leader", F.col("key"))
    first = pairs.join(leads.select(F.col("key").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("key")).agg(F.min("a").alias("first"))
    return keys.join(first, "key", "left").select("key", F.coalesce("first", "key").alias("leader"))


def near_clusters(contexts: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(context_key, cluster) for mining.mine(): the vectors are (context_key, vec). Contexts without a vector stay clusters of their own."""
    own = contexts.select("context_key").distinct()
    led = leaders(vectors.join(own, "context_key", "left_semi").select(F.col("context_key").alias("key"), "vec"), threshold)
    return own.join(led.withColumnRenamed("key", "context_key"), "context_key", "left").select("context_key", F.coalesce("leader", "context_key").alias("cluster"))


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint where the session names a folder for it; a short loop without one keeps its plan."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            return df
        sc.setCheckpointDir(folder)
    return df.checkpoint()
