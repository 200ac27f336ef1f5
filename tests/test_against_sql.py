"""Queries against their own SQL in DuckDB, over small tables made to be awkward."""

import duckdb

from spanloom.plans.catalogue import ORACLE_SQL, QUERIES


def agree(spark, folder, name):
    """The query's rows, which are those of its SQL."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in folder.iterdir():
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = [tuple(r[c] for c in want.columns) for r in QUERIES[name](spark, str(folder)).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    return got


def talks(spark, folder, *said):
    """conversations: a text for each turn, which the user and the assistant take in turns; one that begins with S: is a system prompt."""
    rows = []
    for conv, texts in said:
        system = texts[0].startswith("S:")
        rows += [(conv, k, "system" if system and k == 0 else ("user", "assistant")[(k - system) % 2], t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return folder


ALIKE = [
    (1, ["hi", "a", "more", "b", "end", "c"]), (2, ["hi", "d", "other", "e"]), (3, ["hi", "a", "more", "b", "else", "c"]), (4, ["hi", "f"]), (5, ["hi", "a", "third", "g"]),
    (6, ["S: be brief", "hi", "a"]), (7, ["S: be brief", "hi", "b", "so", "c"]), (8, ["S: be brief", "no", "b"]), (9, ["alone", "x", "y", "z"]),
]


def test_stitch_mixed_of_talks_that_open_alike(spark, tmp_path):
    assert {first // 1000 for _, _, first in agree(spark, talks(spark, tmp_path, *ALIKE), "stitch_mixed")} == set(range(1, 10))


def test_stream_sessions_of_talks_that_open_alike(spark, tmp_path):
    assert len({first for _, first in agree(spark, talks(spark, tmp_path, *ALIKE), "stream_sessions")}) < len(ALIKE)


def test_stream_goes_on_with_a_bare_prompt(spark, tmp_path):
    rows = [(1, 0, "system", "p"), (1, 1, "assistant", "a"), (2, 0, "system", "p"), (2, 1, "user", "q"), (2, 2, "assistant", "b"), (3, 0, "system", "p"), (3, 1, "user", "r"), (3, 2, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert len({first for _, first in agree(spark, tmp_path, "stream_sessions")}) == 2


def test_sessions_without_extensions_give_no_pairs(spark):
    """The join itself has no candidate pairs, whatever the number of exchanges of a session."""
    from spanloom.operators import sessions

    rows = [("s", k, [f"m{k % 3}"]) for k in range(300)] + [("t", 0, []), ("t", 1, ["a"]), ("t", 2, ["a", "b"]), ("t", 3, ["a", "c"]), ("u", 0, ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "session_id string, turn int, norm array<string>")
    pairs = sessions.extensions(df, [])
    assert {tuple(r) for r in pairs.select("session_id", "a_turn", "e_turn").collect()} == {("t", 0, 1), ("t", 0, 2), ("t", 0, 3), ("t", 1, 2), ("t", 1, 3)}
    assert "__key" in pairs._jdf.queryExecution().optimizedPlan().toString()
