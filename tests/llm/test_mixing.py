from collections import Counter

from spanloom.llm import mixing
from tests.llm.conftest import words


def brute(rows, block, weights=None):
    """(slot, source, epoch, block, doc_id) by plain loops. rows: (doc_id, source, tokens, hash)."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2])):
        by.setdefault(r[1], []).append(r)
    plan = mixing.bounds([(s, sum(r[2] for r in own)) for s, own in by.items()], block, weights)
    place = {}
    for s, own in by.items():
        at, total = 0, sum(r[2] for r in own)
        for r in own:
            place.setdefault((s, min(at, max(total - 1, 0)) // block), []).append(r[0])
            at += r[2]
    out, rank, slot, left = [], Counter(), 0, {s for s, *_ in plan}
    while left:
        cell = slot * 2_654_435_769 % 2**32
        s, n, _ = next(p for p in plan if cell < p[2])
        r = rank[s]
        rank[s] += 1
        if rank[s] >= n:
            left.discard(s)
        out += [(slot, s, r // n, r % n, d) for d in place.get((s, r % n), ())]
        slot += 1
    return out


def test_schedule_against_loops(spark, rng):
    import hashlib

    rows = []
    for k in range(150):
        s = rng.choice(["hot", "hot", "hot", "b", None])
        n = rng.choice([0, 3, 8, 20, 200])
        rows.append((k, words(rng, n) if n else None, s, n))
    docs = spark.createDataFrame([(k, t, s) for k, t, s, _ in rows], "doc_id bigint, text string, source string")
    hashed = [(k, s, n, hashlib.md5(f"{mixing.SEED}:{k}".encode()).hexdigest()) for k, _, s, n in rows]
    for block, weights in ((50, None), (64, {"hot": 1, "b": 3, None: 2}), (50, {"b": 1})):
        for most in (0, 10**6):
            got = mixing.mixture(docs, block_tokens=block, weights=weights, broadcast_slots=most).collect()
            assert sorted(((r.slot, r.source, r.epoch, r.block, r.doc_id) for r in got), key=str) == sorted(brute(hashed, block, weights), key=str)
    got = mixing.mixture(docs, block_tokens=50).collect()
    assert {r.doc_id for r in got} == set(range(150))  # nothing is lost


def test_prefixes_are_close_to_the_target(spark):
    plan = mixing.bounds([("a", 700_000), ("b", 200_000), ("c", 100_000)], 100, {"a": 2, "b": 1, "c": 1})
    slots, n = mixing.schedule(spark, plan)
    seen = [r.source for r in slots.orderBy("slot").limit(4000).collect()]
    for k in (100, 1000, 4000):
        assert abs(seen[:k].count("a") - k / 2) < 8 and abs(seen[:k].count("c") - k / 4) < 8
    assert abs(n - 14_000) < 16  # the half of it that a has


def test_edges(spark, make_docs, rng):
    docs = make_docs([(None, "a b"), (1, None), (2, ""), (3, words(rng, 30_000)), (3, "c d"), (3, "c d")], extra=("slot", "__h", "__at"))
    out = mixing.mix(docs, block_tokens=16)
    assert out.where("__c1 = 'c d' AND __epoch = 0").count() == 2 and out.where("__epoch = 0").count() == 6  # s1 and s2 have no token, and a block
    assert mixing.mixed(docs, block_tokens=16).columns == docs.columns
    assert mixing.mixture(docs.limit(0)).count() == 0
    blank = mixing.mixture(make_docs([(1, None), (2, "")]))
    assert blank.count() >= 2 and blank.columns == ["slot", "source", "epoch", "block", "doc_id", "n_tokens"]


def test_many_sources_and_a_hot_one(spark, monkeypatch):
    """Sources by the ten thousand, one of them with half of all tokens; ranks are counted by ranges of slots."""
    monkeypatch.setattr(mixing, "_RANGE", 512)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "if(id % 2 = 0, 'hot', concat('host', id)) AS source")
    rows = mixing.mixture(docs, block_tokens=1000).groupBy("doc_id").agg({"*": "count"}).collect()
    assert len(rows) == 20_000
