from spanloom.llm import shard


def test_permutation_is_a_bijection_and_inverts():
    for n in (1, 2, 3, 5, 17, 64, 1000):
        got = [shard.permute(x, n) for x in range(n)]
        assert sorted(got) == list(range(n))
        assert [shard.unpermute(p, n) for p in got] == list(range(n))


def test_column_is_the_python_permutation_whatever_the_ranges(spark, make_docs, rng):
    ids = rng.sample(range(10_000), 57)
    docs = make_docs([(i, f"t{i}") for i in ids])
    want = {i: shard.permute(k, 57) for k, i in enumerate(sorted(ids))}
    for n in (4, 64):
        rows = shard.shards(docs, n_shards=n).collect()
        assert {r.doc_id: r.position for r in rows} == want
        assert all(r.slot * n + r.shard == r.position for r in rows)
    numbered, n = shard.number_rows(docs.repartition(5), "doc_id", ["text"], ranges=13)
    assert n == 57 and [r.doc_id for r in numbered.orderBy("__n").collect()] == sorted(ids)


def test_ids_that_are_no_numbers(spark):
    rows = [("b", 1), ("a", 2), (None, 3), ("", 4), ("a", 1), ("long " * 500, 5)]
    docs = spark.createDataFrame(rows, "doc_id string, n int")
    got = sorted(spark_row for spark_row in ((r.row_number, r.position, r.doc_id, r.n) for r in shard.shards(docs.repartition(3)).collect()))
    assert [r[0] for r in got] == list(range(6)) and [r[1] for r in got] == [shard.permute(k, 6) for k in range(6)]
    assert got[0][2:] == (None, 3) and [r[3] for r in got if r[2] == "a"] == [1, 2]


def test_nulls_ties_repeats_empty_and_clashing_names(spark, make_docs):
    docs = make_docs([(None, None), (3, "b"), (3, "a"), (3, "a"), (1, ""), (None, "x" * 100_000)], extra=("shard", "__n", "payload"))
    rows = sorted(shard.shards(docs).collect(), key=lambda r: r.row_number)
    assert [r.row_number for r in rows] == list(range(6))
    assert [(r.doc_id, (r.text or "")[:1]) for r in rows] == [(None, ""), (None, "x"), (1, ""), (3, "a"), (3, "a"), (3, "b")]
    assert {r.position for r in rows} == set(range(6)) and all(isinstance(r.shard, int) and r.payload == "mine" for r in rows)
    assert shard.shards(docs.limit(0)).count() == 0
