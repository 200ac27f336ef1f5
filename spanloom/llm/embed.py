"""Near duplicates of embeddings by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of at least `cosine` is a distance of at most epsilon = sqrt(2 - 2 cosine). They are projected on
the leading principal directions of the whole table, which can't lengthen a distance, and sorted lexicographically by their cells on a
grid of width epsilon there: the epsilon grid order. The sequence is cut into blocks; two blocks are joined unless their boxes in the
projected space are more than epsilon apart. A join halves the longer of two intervals of the sequence again and again, drops pairs of intervals
whose boxes are provably distant, and compares what is left by full vectors. The result is exact.

Scale: equal vectors are one node from the start. Boxes, one row a block, are matched in Spark by their cells on the first direction; a block
is sent once to each block that it has to be compared with. Of close vectors a leaf returns a spanning forest and how many links each vector has, so
that m near ones send on the order of m rows, not m squared. How much is skipped depends on the data: in many equally strong directions little can be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apply_arrow, cut, map_arrow, shuffle_partitions
from .graph import components

COSINE, DIRECTIONS, BLOCK_ROWS, LEAF_ROWS = 0.95, 6, 8192, 256


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """((id, vec) of rows with a finite vector that isn't zero, of the most common length, and that length)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    vec = F.col("embedding").cast("array<double>") if kind != "double" else F.col("embedding")
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec"))
    fine = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.where(fine)
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.where(F.size("vec") == length["n"]), length["n"]) if length else (rows, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(nodes: DataFrame, length: int, most: int) -> np.ndarray:
    """The leading principal directions of all vectors, length x most. Tasks send sums, which are added in parts before they reach the driver."""

    def sums(batches):
        n, one, two = 0, np.zeros(length), np.zeros((length, length))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0)))
                n, one, two = n + len(x), one + x.sum(0), two + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([one.tolist()]), pa.array([two.ravel().tolist()])], ["n", "one", "two"])

    def add(table: pa.Table) -> pa.Table:
        n = sum(table.column("n").to_pylist())
        one, two = (np.sum([np.array(x) for x in table.column(c).to_pylist()], axis=0) for c in ("one", "two"))
        return pa.table([pa.array([n]), pa.array([one.tolist()]), pa.array([two.tolist()])], ["n", "one", "two"])

    schema = "n bigint, one array<double>, two array<double>"
    parts = map_arrow(nodes.select("vec"), sums, schema).groupBy((F.spark_partition_id() % 32).alias("g"))
    got = apply_arrow(parts, add, schema).collect()
    n = sum(r["n"] for r in got)
    one, two = (np.sum([np.array(r[c]) for r in got], axis=0) for c in ("one", "two"))
    if not n:
        return np.eye(length)[:, :most]
    spread = two.reshape(length, length) / n - np.outer(one / n, one / n)
    return np.linalg.eigh(spread)[1][:, ::-1][:, :most].copy()


def _leaf(a: np.ndarray, b: np.ndarray, same: bool, cosine: float, links_a: np.ndarray, links_b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row of a, row of b) of a spanning forest of the close pairs; every pair is counted in links_a and links_b."""
    near = a @ b.T >= cosine
    if same:
        near = np.triu(near, 1)
    if not near.any():
        return []
    links_a += near.sum(1)
    links_b += near.sum(0)
    edges: list[tuple[int, int]] = []
    rows_left, cols_left = near.any(1), near.any(0)
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        queue = [int(start)]
        while queue:
            r = queue.pop()
            cols = np.flatnonzero(near[r] & cols_left)
            edges += [(r, int(c)) for c in cols]
            cols_left[cols] = False
            more = np.flatnonzero(near[:, cols].any(1) & rows_left)
            for q in more:
                c = cols[near[q, cols].argmax()]
                edges.append((int(q), int(c)))
            rows_left[more] = False
            queue += more.tolist()
    return edges


def join_intervals(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, same: bool, cosine: float, leaf: int = LEAF_ROWS) -> tuple[list[tuple[int, int]], int, np.ndarray, np.ndarray]:
    """(edges between rows of x and of y, pairs compared, links of each row of x, of y; one array for both where they are the same). px, py: the projections, in the order of the sequence."""
    epsilon2 = 2 - 2 * cosine + 1e-9
    edges: list[tuple[int, int]] = []
    compared = 0
    links_x = np.zeros(len(x), np.int64)
    links_y = links_x if same else np.zeros(len(y), np.int64)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:
            continue  # the mirror image
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if gap @ gap > epsilon2:
            continue
        if b - a <= leaf and d - c <= leaf:
            compared += (b - a) * (d - c)
            edges += [(a + i, c + j) for i, j in _leaf(x[a:b], y[c:d], same and a == c, cosine, links_x[a:b], links_y[c:d])]
        elif same and a == c:
            m = a + (b - a) // leaf // 2 * leaf or a + leaf
            m = max(a + leaf, min(m, b - 1)) if b - a > leaf else b
            todo += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = a + max(1, (b - a) // leaf // 2) * leaf
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = c + max(1, (d - c) // leaf // 2) * leaf
            todo += [(a, b, c, m), (a, b, m, d)]
    return edges, compared, links_x, links_y


def close_pairs(nodes: DataFrame, length: int, cosine: float, most: int = DIRECTIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, n): nodes whose vectors are close, as forests of the blocks' joins, with n = 0; and (a, a, n) for n links of a node."""
    most = min(most, length)
    axes = directions(nodes, length, most)
    epsilon = float(np.sqrt(max(2 - 2 * cosine, 1e-12)))

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1)))
                p = x @ axes
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x)), pa.array(list(p)), pa.array(list(np.floor(p / epsilon).astype(np.int32)))], ["id", "vec", "p", "cell"])

    placed = map_arrow(nodes.select("id", "vec"), project, "id bigint, vec array<double>, p array<double>, cell array<int>")
    order = [F.col("cell")[k] for k in range(most)]
    ordered = placed.repartitionByRange(shuffle_partitions(nodes.sparkSession), *order, "id").sortWithinPartitions(*order, "id")
    at = F.monotonically_increasing_id()
    # The partition is in the upper bits; a block is a stretch of one partition. The checkpoint fixes what range sampling chose.
    blocks = cut(ordered.withColumn("at", at).withColumn("block", F.call_function("div", F.col("at"), F.lit(block_rows).cast("long"))))
    box = blocks.groupBy("block").agg(*[f(F.col("p")[k]).alias(f"{n}{k}") for k in range(most) for n, f in (("lo", F.min), ("hi", F.max))])
    first = F.floor(F.col("lo0") / epsilon), F.floor(F.col("hi0") / epsilon)
    left = box.select(F.explode(F.sequence(first[0] - 1, first[1] + 1)).alias("c0"), *[F.col(c).alias(f"a_{c}") for c in box.columns])
    right = box.select(F.explode(F.sequence(*first)).alias("c0"), *[F.col(c).alias(f"b_{c}") for c in box.columns])
    apart = [F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")) for k in range(most)]
    near = left.join(right, "c0").where(F.col("a_block") <= F.col("b_block")).where(sum((x * x for x in apart), F.lit(0.0)) <= epsilon**2 + 1e-9)
    near = near.select(F.col("a_block").alias("a"), F.col("b_block").alias("b")).distinct()
    sides = near.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("block"))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("at").combine_chunks()
        ids, own = table.column("id").to_numpy(), table.column("block").to_numpy()
        x, p = (_matrix(table.column(c).chunk(0)) for c in ("vec", "p"))
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        i, j = own == a, own == b
        edges, _, links_i, links_j = join_intervals(x[i], p[i], x[j], p[j], a == b, cosine)
        e = np.array(edges, np.int64).reshape(-1, 2)
        counted = [(ids[i], links_i)] + ([] if a == b else [(ids[j], links_j)])
        who, links = (np.concatenate([c[k][c[1] > 0] for c in counted]) for k in (0, 1))
        return pa.table([pa.array(np.concatenate([ids[i][e[:, 0]], who])), pa.array(np.concatenate([ids[j][e[:, 1]], who])), pa.array(np.concatenate([np.zeros(len(e), np.int64), links]))], ["a", "b", "n"])

    met = sides.join(blocks, "block").select("a", "b", "block", "id", "at", "vec", "p")
    return apply_arrow(met.groupBy("a", "b"), link, "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, most: int = DIRECTIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, class_id, n_links): for each vector its class and how many other vectors, equal ones counted once, are close to it.

    A class is a connected component of pairs with a cosine of at least `cosine`, named by its least vec_id, which is the one to keep. Rows with a null
    id, a null or empty vector, a null or infinite element, only zeros, or a length that isn't the most common one are left out. Rows that repeat id
    and vector are one; an id with several vectors puts their classes together and has the links of all. An empty table gives no rows. Other columns
    are not read.
    """
    rows, length = _usable(vectors)
    if not length:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, class_id bigint, n_links bigint")
    rows = rows.select("id", "vec").withColumn("h", F.xxhash64("vec"))
    nodes = rows.groupBy("h").agg(F.min("id").alias("id"), F.first("vec").alias("vec"))
    # A node is named by its hash, as one id may have several vectors.
    found = cut(close_pairs(nodes.select(F.col("h").alias("id"), "vec"), length, cosine, most, block_rows))
    links = found.where("a = b").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("n"))
    member = rows.select("id", "h").distinct()
    least = member.groupBy("h").agg(F.min("id").alias("least"))
    ids = lambda c: least.select(F.col("h").alias(c), F.col("least").alias(f"id_{c}"))
    between = found.where("a <> b").join(ids("a"), "a").join(ids("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    equal = member.join(least, "h").select(F.col("id").alias("a"), F.col("least").alias("b")).where("a <> b")
    roots = components(equal.unionByName(between))
    each = member.join(links, "h", "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_links"))
    return each.join(roots, F.col("id") == F.col("node"), "left").select(F.col("id").alias("vec_id"), F.coalesce("root", "id").alias("class_id"), "n_links")


def oracle(cosine: float = COSINE) -> str:
    """DuckDB SQL for op4_embedding_near_dedup: all pairs, and reachability by recursion."""
    return f"""
WITH RECURSIVE pair AS (
  SELECT a.vec_id AS u, b.vec_id AS v, b.embedding <> a.embedding AS other, b.embedding AS e FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {cosine}),
reach(u, v) AS (SELECT u, v FROM pair UNION SELECT r.u, p.v FROM reach r JOIN pair p ON p.u = r.v),
links AS (SELECT u, count(DISTINCT e) FILTER (other) AS n FROM pair GROUP BY u),
root AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT vec_id, least(vec_id, coalesce(root.v, vec_id)) AS class_id, coalesce(n, 0) AS n_links FROM embeddings LEFT JOIN root ON root.u = vec_id LEFT JOIN links ON links.u = vec_id
"""
