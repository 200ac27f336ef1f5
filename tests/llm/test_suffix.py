import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import suffix
from tests.llm.conftest import words


def brute(docs, k):
    """Words covered by a window of k words that an earlier place has, over all windows."""
    seen, out = {}, set()
    for d, text in sorted(docs):
        w = re.findall(r"[^\t-\r\x1c-\x20]+", text or "")
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if seen.setdefault(key, (d, p)) != (d, p):
                out |= {(d, q) for q in range(p, p + k)}
    return out


def covered(rows):
    return {(r.doc_id, q) for r in rows for q in range(r.start, r.end)}


def test_against_all_windows(spark, make_docs, rng):
    passages = [words(rng, n) for n in (49, 50, 51, 60, 200)]
    texts = []
    for k in range(60):
        w = words(rng, rng.randint(0, 150)).split()
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = p.split()
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += ["ha " * 130, "ab cd ef " * 40, texts[3], texts[3]]
    want = brute(list(enumerate(texts)), 50)
    rows = suffix.repeats(make_docs(texts).repartition(5)).collect()
    assert covered(rows) == want and len(want) > 2000
    by = {}
    for r in rows:
        assert r.n_tokens == r.end - r.start >= 50
        by.setdefault(r.doc_id, []).append((r.start, r.end))
    for own in by.values():
        own.sort()
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=4, max_size=4).map(lambda b: bytes(x & 1 for x in b)), max_size=8), min_size=1, max_size=6))
def test_loser_tree_merges_and_groups(runs):
    runs = [sorted(set(r)) for r in runs]

    def shared(a, b):
        n = 0
        while n < len(a) and a[n] == b[n]:
            n += 1
        return n

    prefixes = [[0, *(shared(a, b) for a, b in zip(r, r[1:]))] for r in runs]
    groups = suffix.merge(runs, prefixes)
    order = {s: k for k, s in enumerate(sorted({s for r in runs for s in r}))}
    assert groups == [[order[s] for s in r] for r in runs]


def test_runs_survive_packing():
    passages = [b"one two three four ", b"two three five "]
    entries = sorted([(0, 0, 8), (0, 1, 14), (1, 0, 10), (1, 1, 15)], key=lambda e: passages[e[0]].split()[e[1] : e[1] + 2])
    where, nth = (np.array([e[k] for e in entries]) for k in (0, 1))
    texts = [b" ".join(passages[w].split()[k : k + 2]) + b" " for w, k in zip(where, nth)]
    shared = [0, *(suffix.shared_prefix(x, y) for x, y in zip(texts, texts[1:]))]
    got = suffix.unpack(suffix.pack(passages, where, nth, np.array(shared)), 2)
    assert got[:2] == (texts, shared) and (got[2] == where).all() and (got[3] == nth).all()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=6).map(lambda b: bytes(x & 1 for x in b)), st.binary(max_size=6).map(lambda b: bytes(x & 1 for x in b)))
def test_shared_prefix(x, y):
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    assert all(suffix.shared_prefix(x, y, k) == n for k in range(n + 1))


def test_a_passage_in_most_documents(spark, make_docs, rng, monkeypatch):
    """It sends an entry for each of its suffixes from each run, however many documents have it."""
    hot = words(rng, 90)
    texts = [f"a b c d e{k} {hot} f{k} g" for k in range(600)] + [words(rng, 120) for _ in range(50)]
    docs = make_docs(texts).coalesce(1)
    rows = suffix._identity(docs)
    twice = suffix.repeated_seeds(suffix.seeds(rows, 50, 16))
    runs = suffix._runs(rows.join(twice, "rid").coalesce(1), 50, 16, 3).where("run IS NOT NULL").collect()
    sent = [x for r in runs for x in suffix.unpack(bytes(r.run), 50)[0]]
    assert len(sent) == len({*sent}) <= 41 + 600 * 12
    assert covered(suffix.repeats(docs).collect()) == {(d, q) for d in range(1, 600) for q in range(5, 95)}


def test_removal(spark, rng):
    p, other = words(rng, 60), words(rng, 70)
    docs = spark.createDataFrame([("b", f"é {p}\n{other}"), ("a", p.replace(" ", "\t")), ("c", other), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r.text for r in suffix.deduplicate(docs).collect()}
    assert got == {"a": p.replace(" ", "\t"), "b": f"é \n{other}", "c": "", None: None}


def test_edges(spark, make_docs, rng):
    p = words(rng, 70)
    docs = make_docs([(5, p), (5, p), (None, p), (2, "x " + p), (3, None), (4, ""), (6, words(rng, 40)), (7, words(rng, 20_000) + " " + p)], extra=("rid", "start", "seeds"))
    got = {(r.doc_id, r.start, r.end) for r in suffix.repeats(docs).collect()}
    assert got == {(5, 0, 70), (None, 0, 70), (7, 20_000, 20_070)}
    assert suffix.repeats(docs.limit(0)).count() == 0
