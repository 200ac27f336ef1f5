import numpy as np
import pyarrow as pa

from spanloom.operators import cluster


def test_blocks_follow_the_input():
    """A vector is sent to as many blocks as there are: eight, till a block of 16 MB is full. It was n / 2048, 51 at 102,564 vectors."""
    assert {-(-n // cluster._block(n, 64)) for n in (20_000, 102_564, 250_000)} == {8} and cluster._block(615_384, 64) * 64 * 8 == cluster.BLOCK_BYTES
    assert cluster._block(1000, 64) == 2048 and cluster._block(10**6, 8192) == 256


def test_units():
    batch = pa.RecordBatch.from_pydict({"key": [*range(8)], "vec": pa.array([[3.0, 4.0], None, [], [0.0, 0.0], [1.0, None], [1.0, 2.0, 2.0], [float("nan"), 1.0], [1e200, 1e200]], pa.list_(pa.float64()))})
    got = {k: u for b in cluster._units(iter([batch])) for k, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert got == {0: [0.6, 0.8], 5: [1 / 3, 2 / 3, 2 / 3]}


def test_pairs_and_leaders_over_several_tiles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    x[1500:1600] = x[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.97, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "key bigint, vec array<double>")
    for block in (None, 1300):
        got = cluster.close_pairs(df, 0.97, block).collect()
        assert len(got) == len(a) and {(r.a, r.b) for r in got} == {*zip(a.tolist(), b.tolist())}
    near: dict[int, list[int]] = {}
    for i, j in zip(a.tolist(), b.tolist()):
        near.setdefault(j, []).append(i)
    want: dict[int, int] = {}
    for k in range(3000):
        want[k] = next((h for h in sorted(near.get(k, [])) if want[h] == h), k)
    assert {r.key: r.leader for r in cluster.leaders(df, 0.97).collect()} == want
