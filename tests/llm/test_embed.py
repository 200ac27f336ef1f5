import numpy as np

from spanloom.llm import embed

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def groups(ids, x, cosine):
    x = np.array(x, float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in np.argwhere(x @ x.T >= cosine):
        a, b = find(i), find(j)
        root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {(ids[i], ids[find(i)]) for i in range(len(ids)) if find(i) != i}


def links(ids, x, cosine):
    """How many different vectors are close to each."""
    u, which = np.unique(x, axis=0, return_inverse=True)
    unit = u.astype(float) / np.linalg.norm(u.astype(float), axis=1, keepdims=True)
    n = (unit @ unit.T >= cosine).sum(1) - 1
    return {i: int(n[k]) for i, k in zip(ids, which)}


def planted(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(2, 0.3, d)
    near = [x[k % 40] * rng.uniform(0.5, 3) + rng.normal(size=d) * 0.03 for k in range(90)]
    chain = [np.eye(d)[0] + np.eye(d)[1] * t for t in np.linspace(0, 3, 30)]
    return np.vstack([x, near, chain, np.tile(x[7], (80, 1))])


def test_against_all_pairs_whatever_the_blocks(spark):
    x = planted()
    ids = np.random.default_rng(1).permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    want = groups(ids, x.astype(np.float32), 0.95)
    for rows in (16, 8192):
        got = embed.near_duplicates(df, block_rows=rows).collect()
        assert {(r.vec_id, r.class_id) for r in got if r.vec_id != r.class_id} == want and len(want) > 150
        assert {r.vec_id: r.n_links for r in got} == links(ids, x.astype(np.float32), 0.95)


def test_intervals_are_skipped_but_no_pair_is_lost():
    rng = np.random.default_rng(2)
    x = embed._unit(rng.normal(size=(2000, 8)) * [5, 3, 1, 0.2, 0.2, 0.2, 0.2, 0.2])
    p = x[:, :4]
    epsilon = np.sqrt(2 - 2 * 0.98)
    order = np.lexsort(np.floor(p / epsilon).T[::-1])
    x, p = x[order], p[order]
    edges, compared, own, _ = embed.join_intervals(x, p, x, p, True, 0.98, leaf=32)
    assert compared < 2000 * 2000 / 2 * 0.6
    want = {(i, j) for i, j in np.argwhere(x @ x.T >= 0.98) if i < j}
    assert {tuple(e) for e in edges} <= want and (own == (x @ x.T >= 0.98).sum(1) - 1).all()
    root = list(range(2000))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in edges:
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i, j in want)


def test_edges(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.5]
    rows = [(3, v), (1, [2.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (None, v), (4, None), (5, []), (6, [0.0] * 3), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [1.0, 0.0]), (10, w), (11, [float("inf"), 1.0, 1.0]), (12, w)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).selectExpr("*", "'mine' AS id", "1 AS block")
    assert {tuple(r) for r in embed.near_duplicates(df).collect()} == {(3, 1, 1), (1, 1, 1), (12, 10, 0), (10, 10, 0)}
    assert embed.near_duplicates(df.limit(0)).count() == 0
    assert embed.near_duplicates(df.where("vec_id IN (4, 5, 6)")).count() == 0
    assert {tuple(r) for r in embed.near_duplicates(df.where("vec_id = 3")).collect()} == {(3, 3, 0)}
