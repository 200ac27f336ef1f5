"""Queries read whole tables: small tables whose keys and dates lie where a cut would lose them."""

from spanloom.plans.catalogue import QUERIES


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"


def test_toolset_health(spark, tmp_path):
    d = write(spark, tmp_path, "part", [(k, "n", "B", "T", k % 3) for k in (1, 3, 200, 201, 221, 302, 4000)], PART)
    got = {(r.code, r.message) for r in QUERIES["toolset_health"](spark, d).collect()}
    assert got == {
        ("duplicate-tool", "more than one tool is called twice"), ("no-args", "B-3 takes no arguments"), ("no-args", "twice takes no arguments"),
        ("unconstrained-args", "B-200 accepts any arguments"), ("unconstrained-args", "twice accepts any arguments"), ("unconstrained-args", "B-302 accepts any arguments"),
    }


def test_lexical_overlap(spark, tmp_path):
    write(spark, tmp_path, "part", [(3, "red ring", "B", "SMALL", 1), (51, "Blue bolt", "B", "SMALL", 1), (9000, "green nut", "B", "LARGE", 1)], PART)
    said = [(1, 0, "user", "A green BOLT, a green nut"), (1, 1, "assistant", "red"), (2, 0, "user", "?!"), (2, 2, "user", None), (3, 0, "user", "nothing here"), (4, 0, "user", "red small"), (5, 0, "user", "red small")]
    d = write(spark, tmp_path, "conversations", said, "conv_id bigint, turn int, role string, text string")
    got = sorted((r.conv_id, r.turn, r.overlap) for r in QUERIES["lexical_overlap"](spark, d).collect())
    assert got == [(1, 0, 0.75), (2, 0, 1.0), (2, 2, 1.0), (3, 0, 0.0), (4, 0, 1.0), (5, 0, 1.0)]


def test_simulated_scorecard(spark, tmp_path):
    from spanloom.plans import scorecards

    d = write(spark, tmp_path, "part", [(k, f"n{k % 50}", "B", "old" if k < 100 else "new", 1) for k in range(200)], PART)
    tools = [t["function"] for t in scorecards._part_tools(spark, d)]
    names = {"twice"} | {f"n{k % 50}" for k in range(200) if k % 20}
    assert len(tools) == len(names) and {t["name"] for t in tools} == names and {t["description"] for t in tools} == {"Handles new."}
    scores = {r.capability: r.score for r in QUERIES["simulated_scorecard"](spark, d).collect()}
    assert len(scores) == 11 and scores["tool_selection"] == round(int(0.67 * len(names) + 0.5) / len(names), 4)


def test_errored_over_all_days(spark, tmp_path):
    from datetime import datetime

    def events(folder, rows):
        return write(spark, folder, "events", [(k, u, kind, '{"k": 1}', datetime(2024, 1, day)) for k, (u, kind, day) in enumerate(rows)], "event_id bigint, user_id bigint, event_type string, props string, ts timestamp")

    d = events(tmp_path / "a", [(1, "error", 2), (1, "error", 9), (3, "error", 3), (3, "view", 5), (6, "view", 20), (2, "error", 8)])
    assert {tuple(r) for r in QUERIES["error_derived_negatives"](spark, d).collect()} == {("tool_restraint", 1, 2)}
    verdicts = [(d, False), (events(tmp_path / "b", [(1, "error", 3), (2, "view", 4)]), False), (events(tmp_path / "c", [(1, "error", 4)]), True)]
    assert all(QUERIES["all_errored_guard"](spark, x).first()[0] is want for x, want in verdicts)


def test_trend_ladder(spark, tmp_path):
    from datetime import date

    lines = [(1992, 6, 0.05), (1992, 6, 0.01), (1994, 6, 0.05), (1998, 6, 0.01), (1993, 5, 0.05), (1998, 5, 0.05), (1995, 7, 0.01)]
    rows = [(key, n, "A", "F", date(year, 5, 1), discount) for year, n, discount in lines for key in range(3)]
    d = write(spark, tmp_path, "lineitem", [*rows, (0, 7, "A", "F", date(1996, 5, 1), 0.05), (1, 7, "A", "F", date(1996, 5, 1), 0.01), (2, 7, "A", "F", date(1996, 5, 1), 0.01)], "l_orderkey bigint, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate date, l_discount double")
    got = {r.capability: (r.ladder, r.status) for r in QUERIES["trend_ladder"](spark, d).collect()}
    assert got == {"AF6": ("5000 - 10000 - - - 0", "regressed"), "AF5": ("- 10000 - - - - 10000", "stable"), "AF7": ("- - - 0 3333 - -", "removed")}
