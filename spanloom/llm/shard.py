"""Sharding by a Feistel permutation with cycle walking.

Rows are numbered 0 .. n-1 in the order of their columns, the permutation maps the number to a position, and position = slot * shards +
shard: all three can be computed for any row number alone, and inverted. The permutation is a Feistel network of modular additions over
a rectangle a x b that holds n points with a = ceil(sqrt(n)), b = ceil(n / a); fewer than a points lie beyond n, and a position that
falls there is walked on along its cycle until it doesn't.

Scale: numbering needs no global sort. Quantiles of the leading key cut the rows into ranges; one narrow pass counts each range, the
counts give offsets, and a window numbers the rows inside each range. The rows are shuffled once. All of it is a pure function of the
row, so a recomputed task gives the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import shuffle_partitions

SHARDS, SEED, ROUNDS = 64, 20_240_601, 7
_MOD = 2_147_483_647  # products of two residues stay below 2 ** 62


def round_keys(seed: int, rounds: int) -> list[tuple[int, int, int]]:
    """(multiplier, addend, addend) of each round, from a linear congruential sequence."""
    keys, x = [], seed % _MOD
    for _ in range(rounds):
        own = []
        for _ in range(3):
            x = (x * 48271 + 11) % _MOD
            own.append(x)
        keys.append((own[0] + 1, own[1], own[2]))
    return keys


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(x: int, n: int, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """The position of row number x of n, in plain Python."""
    a, b = sides(n)
    while True:
        left, right = x % a, x // a
        for k, (m, c, d) in enumerate(round_keys(seed, rounds)):
            if k % 2 == 0:
                left = (left + _noise(right, m, c, d)) % a
            else:
                right = (right + _noise(left, m, c, d)) % b
        x = right * a + left
        if x < n:
            return x


def unpermute(x: int, n: int, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """The row number at position x of n."""
    a, b = sides(n)
    while True:
        left, right = x % a, x // a
        for k, (m, c, d) in reversed([*enumerate(round_keys(seed, rounds))]):
            if k % 2 == 0:
                left = (left - _noise(right, m, c, d)) % a
            else:
                right = (right - _noise(left, m, c, d)) % b
        x = right * a + left
        if x < n:
            return x


def _noise(x: int, m: int, c: int, d: int) -> int:
    t = (x % _MOD * m + c) % _MOD
    return (t * t + d) % _MOD


def _network(x: Column, n: int, seed: int, rounds: int) -> Column:
    """One pass of the network, as a fold over the round keys so that each half is computed once."""
    a, b = (F.lit(side).cast("long") for side in sides(n))
    mod = F.lit(_MOD).cast("long")
    keys = F.array(*[F.struct(F.lit(k % 2 == 0).alias("even"), *[F.lit(v).cast("long").alias(name) for name, v in zip("mcd", key)]) for k, key in enumerate(round_keys(seed, rounds))])

    def step(halves: Column, key: Column) -> Column:
        other = F.when(key["even"], halves["right"]).otherwise(halves["left"])
        noise = F.transform(F.array((other % mod * key["m"] + key["c"]) % mod), lambda t: (t * t + key["d"]) % mod)[0]
        left = F.when(key["even"], (halves["left"] + noise) % a).otherwise(halves["left"])
        right = F.when(key["even"], halves["right"]).otherwise((halves["right"] + noise) % b)
        return F.struct(left.alias("left"), right.alias("right"))

    begin = F.struct((x % a).alias("left"), F.call_function("div", x, a).alias("right"))
    return F.aggregate(keys, begin, step, lambda h: h["right"] * a + h["left"])


def position(number: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The position of a row number below n: the network, then the walk for the few that land beyond n.

    A walk can't be longer than the number of points beyond n. There are fewer of them than the square root of n, so that a walk of over
    64 steps has a probability below 64 ** -64; it would raise, not give a wrong position.
    """
    a, b = sides(n)
    once = _network(number, n, seed, rounds)
    steps = min(a * b - n, 64)
    if not steps:
        return once
    limit = F.lit(n).cast("long")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once, lambda x, _: F.when(x < limit, x).otherwise(_network(x, n, seed, rounds)))
    return F.aggregate(F.array(walk), F.lit(0).cast("long"), lambda _, x: F.when(x < limit, x).otherwise(F.raise_error(F.lit("the walk didn't end")).cast("long")))


def number_rows(df: DataFrame, key: str, ties: list[str], ranges: int | None = None) -> tuple[DataFrame, int]:
    """(rows with __range, __n = the row number, n): 0, 1, ... in the order of key and ties, nulls first.

    Only key is read to place the ranges and to count them. Where the quantiles fall has no influence on the numbers.
    """
    ranges = ranges or 4 * shuffle_partitions(df.sparkSession)
    cuts = df.select(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    cuts = sorted({c for c in cuts or []})
    if cuts:
        jumps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        bounds, most = F.array(*map(F.lit, cuts)), F.lit(len(cuts))
        found = F.aggregate(F.array(*map(F.lit, jumps)), F.lit(0), lambda at, jump: F.when((at + jump <= most) & (F.get(bounds, at + jump - 1) <= F.col(key)), at + jump).otherwise(at))
        placed = df.withColumn("__range", F.when(F.col(key).isNull(), -1).otherwise(found))
    else:
        placed = df.withColumn("__range", F.when(F.col(key).isNull(), -1).otherwise(0))
    counts = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}
    before, n = {}, 0
    for k in sorted(counts):
        before[k], n = n, n + counts[k]
    offsets = F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(-1, max(before, default=0) + 1)])
    inside = Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ties])
    return placed.withColumn("__n", F.get(offsets, F.col("__range") + 1) + F.row_number().over(inside) - 1), n


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """docs with row_number, position, shard and slot (those names are replaced where docs has them).

    Rows are numbered by doc_id, or by its hash where it isn't a number, ties by the other columns in order of name, nulls first; columns that
    have no order (maps, variants) don't count; rows that are alike in all of them take consecutive numbers. Shards differ in size by one row at most; slots of a shard are 0, 1, ... An empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("row_number", "position", "shard", "slot", "__range", "__n", "__key")]
    docs = docs.select(*own)
    ties = [c for c in sorted(own) if "map" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    number = isinstance(docs.schema["doc_id"].dataType, NumericType)
    key = F.col("doc_id") if number else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    numbered, n = number_rows(docs.withColumn("__key", key), "__key", ["doc_id", *ties])
    place = position(F.col("__n"), n, seed, rounds) if n else F.col("__n")
    split = F.lit(n_shards).cast("long")
    out = numbered.select(*own, F.col("__n").cast("long").alias("row_number"), place.alias("position"))
    return out.select("*", (F.col("position") % split).alias("shard"), F.call_function("div", F.col("position"), split).alias("slot"))


def oracle(n_shards: int = SHARDS, seed: int = SEED, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for op1_sharding: the numbers by a global window, the walk by recursion."""
    mod = _MOD
    inner = "SELECT row_number, x % a AS l, x // a AS r, a, b, n FROM todo"
    for k, (m, c, d) in enumerate(round_keys(seed, rounds)):
        src = "r" if k % 2 == 0 else "l"
        noise = f"SELECT *, ({src} % {mod} * {m} + {c}) % {mod} AS t FROM ({inner})"
        new = f"(l + (t * t + {d}) % {mod}) % a AS l, r" if k % 2 == 0 else f"l, (r + (t * t + {d}) % {mod}) % b AS r"
        inner = f"SELECT row_number, {new}, a, b, n FROM ({noise})"
    return f"""
WITH RECURSIVE numbered AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, lang NULLS FIRST, n_chars NULLS FIRST, source NULLS FIRST, text NULLS FIRST) - 1 AS row_number, count(*) OVER () AS n FROM documents),
size AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM documents)),
sides AS (SELECT n, a, (n + a - 1) // a AS b FROM size),
walk(row_number, x, steps) AS (
  SELECT row_number, row_number, 0 FROM numbered
  UNION ALL
  SELECT row_number, r * a + l, steps + 1 FROM (
    WITH todo AS (SELECT row_number, x, steps, a, b, n FROM walk, sides WHERE steps = 0 OR x >= n)
    SELECT f.*, todo.steps FROM ({inner}) f JOIN todo USING (row_number)))
SELECT doc_id, w.row_number AS row_number, x AS position, x % {n_shards} AS shard, x // {n_shards} AS slot
FROM walk w JOIN numbered USING (row_number) CROSS JOIN sides WHERE steps > 0 AND x < sides.n
"""
