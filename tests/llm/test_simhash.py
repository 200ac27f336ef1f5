import numpy as np
import pyarrow as pa

from spanloom.llm import simhash
from spanloom.llm.common import utf8
from spanloom.llm.graph import components
from tests.llm.conftest import words


def shared(distance, n, rng):
    """The share of random pairs at that distance that have a key in common."""
    x = rng.integers(0, 2, (n, 92))
    y = x.copy()
    for i in range(n):
        y[i, rng.choice(92, distance, replace=False)] ^= 1
    weights = 1 << np.arange(23)
    hits = np.zeros(n, int)
    for s in range(4):
        (a, na), (b, nb) = (simhash.codewords((z[:, s * 23 : s * 23 + 23] * weights).sum(1)) for z in (x, y))
        a = np.where(np.arange(6) < na[:, None], a, -1)
        b = np.where(np.arange(6) < nb[:, None], b, -2)
        hits += (a[:, :, None] == b[:, None, :]).any((1, 2))
    return (hits >= 2).mean()


def test_golay_code_is_perfect_and_keys_find_close_pairs():
    patterns, count = simhash._errors()
    assert sorted(set(count.tolist())) == [1, 6] and (count == 1).sum() == 1 + 23 + 253
    word = np.arange(1 << 23, dtype=np.int64)[::4097]
    assert not simhash.syndrome(word ^ patterns[simhash.syndrome(word), 0]).any()
    rng = np.random.default_rng(1)
    assert shared(8, 3000, rng) == 1 and shared(11, 3000, rng) > 0.97 and shared(12, 3000, rng) > 0.94


def test_fingerprint_by_its_definition():
    from spanloom.llm.common import mix
    from spanloom.llm.common import words as tokens

    texts = ["b a a c", "", "É é x1", "one two " * 40_000]
    low, high, count = simhash.fingerprint(*utf8(pa.array(texts), lower=True))
    assert count.tolist() == [3, 0, 2, 2] and low[1] == high[1] == 0
    for k, t in enumerate(texts):
        hashes = np.unique(tokens(*utf8(pa.array([t]), lower=True))[0])
        raw = np.stack([mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), mix(hashes ^ np.uint64(0x14057B7EF767814F))], 1).view(np.uint8)
        bits = 2 * np.unpackbits(raw, axis=1)[:, :92].sum(0, dtype=int) > len(hashes)
        assert bits[:46] @ (1 << np.arange(46)) == low[k] and bits[46:] @ (1 << np.arange(46)) == high[k]


def planted(rng):
    """Texts in 25 groups of near copies and 60 without one."""
    texts, group = [], []
    for g in range(25):
        base = words(rng, 220).split()
        for _ in range(60 if g == 0 else rng.choice([2, 2, 3, 4])):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = words(rng, 1)
            texts.append(" ".join(own))
            group.append(g)
    for k in range(60):
        texts.append(words(rng, 200))
        group.append(100 + k)
    return texts, group


def test_recall_against_all_pairs(spark, make_docs, rng):
    texts, group = planted(rng)
    prints = simhash.fingerprints(make_docs(texts)).collect()
    at = {r.doc_id: (r.low, r.high) for r in prints}
    near = {(a, b) for a in at for b in at if a < b and sum((x ^ y).bit_count() for x, y in zip(at[a], at[b])) <= simhash.DISTANCE}
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(make_docs(texts)).collect()}
    root = lambda d: got.get(d, d)
    assert len(near) > 100 and np.mean([root(a) == root(b) for a, b in near]) >= 0.9
    assert all(group[d] == group[k] for d, k in got.items())
    kept = {r.doc_id for r in simhash.drop_near_duplicates(make_docs(texts)).collect()}
    assert kept == set(range(len(texts))) - set(got)
    for broadcast in (0, 10):
        assert {r.doc_id for r in simhash.drop_near_duplicates(make_docs(texts), broadcast_rows=broadcast).collect()} == kept


def test_large_keys_send_a_forest(rng):
    low = np.array([rng.getrandbits(46) for _ in range(3)] * 40, np.int64)
    edges = simhash._forest(low, low, 2)
    assert len(edges) == 120 - 3


def test_edges(spark, make_docs, rng):
    a, b = words(rng, 80), words(rng, 90)
    docs = make_docs([(4, a), (2, a), (2, a), (None, a), (7, None), (8, None), (9, ""), (10, "--"), (11, ""), (12, b), (12, b), (None, b)], extra=("tid", "low", "__tid", "node"))
    got = sorted(((r.doc_id, r.kept_doc_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 2), (None, 2), (2, 2), (None, 12), (12, 12)], key=str)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 7, 8, 9, 10, 11, 12]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
