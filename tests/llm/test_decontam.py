import re

from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import decontam
from tests.llm.conftest import words


def brute(item, text, m):
    """Tokens covered by greedy tiling, by its definition: the longest common free run, again and again."""
    fi, ft, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and fi[i + n] and ft[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < m:
            return total
        for k in range(n):
            fi[i + k] = ft[j + k] = False
        total += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=3, max_size=16), st.lists(st.integers(0, 3), max_size=24))
def test_tiling_covers_what_the_definition_covers(item, text):
    assert sum(n for _, _, n in decontam.tiles(item, text, 3)) == brute(item, text, 3)


def test_all_pairs(spark, make_docs, rng):
    items = [words(rng, rng.randint(8, 30)) for _ in range(12)]
    texts = []
    for k in range(40):
        body = words(rng, 60).split()
        if k % 2:
            part = items[k % 12].split()
            cut = rng.randint(0, len(part))
            part = part[cut:] + words(rng, 3).split() + part[:cut]  # moved parts
            body[20:20] = part
        texts.append(" ".join(body).upper() if k % 3 else " -- ".join(body))
    bench = spark.createDataFrame([*enumerate(items)], "item_id bigint, text string")
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    want = {}
    for d, t in enumerate(texts):
        for i, b in enumerate(items):
            c = brute(split(b), split(t), 5)
            if c / len(split(b)) >= 0.5:
                want[d, i] = c
    for chunk in (32 << 20, 400):
        got = {(r.doc_id, r.item_id): r.n_covered for r in decontam.contamination(make_docs(texts), bench, chunk_bytes=chunk).collect()}
        assert got == want and len(want) >= 15
        kept = {r.doc_id for r in decontam.decontaminate(make_docs(texts), bench, chunk_bytes=chunk).collect()}
        assert kept == set(range(40)) - {d for d, _ in want}


def test_case_and_marks_dont_count(spark, make_docs):
    bench = spark.createDataFrame([(1, "One two, three four. Five six seven")], "item_id bigint, text string")
    docs = make_docs(["xx ONE TWO THREE FOUR; five “six” seven yy", "É one"])
    assert [(r.doc_id, r.coverage) for r in decontam.contamination(docs, bench).collect()] == [(0, 1.0)]


def test_edges(spark, make_docs):
    item = "a b c d e f g h"
    bench = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "a b")], "item_id bigint, text string")
    docs = make_docs([(None, item), (5, item), (5, item), (6, None), (7, ""), (8, "z " * 50_000 + item)], extra=("item_id", "coverage"))
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contamination(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (None, 5, 8) for i in (1, None)], key=str)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [6, 7]
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 6
