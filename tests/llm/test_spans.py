import re

import numpy as np

from spanloom.llm import spans
from tests.llm.conftest import sentences, words

CUT = re.compile(r"(?<=[.!?;:,] )|(?<=[。！？；：，、\n])")


def brute(docs, least):
    """{doc_id: text} of those that change. Every run of pieces with `least` characters is looked up among all runs that come before it."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        parts = CUT.split(text or "")
        said = [(k, s.strip(" \n\r\t")) for k, s in enumerate(parts) if s.strip(" \n\r\t")]
        gone, ends = set(), [k for k, _ in said[1:]] + [len(parts)]  # a blank piece goes with the one before
        for i in range(len(said)):
            for j in range(i, len(said)):
                own = tuple(s for _, s in said[i : j + 1])
                if sum(map(len, own)) < least:
                    continue
                if own in seen:
                    gone |= set(range(said[i][0], ends[j]))
                seen.add(own)
        if gone:
            out[d] = "".join(s for k, s in enumerate(parts) if k not in gone)
    return out


def corpus(rng):
    shared = [sentences(rng, n) for n in (1, 2, 3, 4, 7)] + [words(rng, 30).replace(" ", ", ", 3) + "; " + words(rng, 9)]
    texts = []
    for _ in range(70):
        parts = [sentences(rng, rng.randint(0, 5)) for _ in range(3)]
        for s in rng.sample(shared, rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), rng.choice([s, s, words(rng, 2) + " " + s + " " + words(rng, 2)]))
        texts.append(rng.choice(["\n", " ", "\n\n ", " \t\r\n"]).join(parts))
    texts += ["A! " * 90, "WE! ARE! LOUD! " * 12, "。ö！" * 70, "天地，玄黄；" * 20 + "x", "天地，玄黄；" * 19, texts[5], "".join("\x01" if c == "," else c for c in texts[6]), texts[6] + "\x01"]
    return texts


def test_against_every_run(spark, make_docs, rng):
    texts = corpus(rng)
    for least in (120, 40, 1):
        want = brute(list(enumerate(texts)), least)
        got = {r.doc_id: (r.text, r.n_chars, r.n_removed) for r in spans.shortened(make_docs(texts).repartition(4), least).collect()}
        assert got == {k: (t, len(texts[k]), len(texts[k]) - len(t)) for k, t in want.items()} and len(want) > 10
        whole = {r.doc_id: r.text for r in spans.deduplicate(make_docs(texts), least).collect()}
        assert whole == {k: want.get(k, t) for k, t in enumerate(texts)}


def test_chunks_only_save_rows(spark, make_docs, rng, monkeypatch):
    """A hot span: however many documents of a task share it, it sends a row a chunk."""
    hot = sentences(rng, 20)
    docs = make_docs([f"{hot} {sentences(rng, 1)}" for _ in range(400)]).coalesce(1)
    rows = spans._spans(docs, spans.MIN_CHARS).where("NOT late").groupBy("h").count()
    assert rows.where("count > 1").count() == 0
    assert spans.shortened(docs).count() == 399


def test_ids_that_are_strings(spark, rng):
    s = sentences(rng, 5)
    docs = spark.createDataFrame([("b", s), ("a", "Why? " + s), (None, s), ("c", None)], "doc_id string, text string")
    assert {(r.doc_id, r.text) for r in spans.shortened(docs).collect()} == {("b", ""), (None, "")}


def test_edges(spark, make_docs, rng):
    s = sentences(rng, 5)
    docs = make_docs([(3, s), (3, s), (None, s), (1, s + " More here."), (2, None), (4, ""), (5, "One. Two."), (6, ". . .")], extra=("start", "h", "cut"))
    got = sorted(((r.doc_id, r.text, r.n_chars, r.n_removed) for r in spans.shortened(docs).collect()), key=str)
    assert got == sorted([(3, "", len(s), len(s)), (3, "", len(s), len(s)), (None, "", len(s), len(s))], key=str)
    out = spans.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == 8 and out.where("text IS NULL").count() == 1
    assert spans.shortened(docs.limit(0)).count() == 0 and spans.deduplicate(docs.limit(0)).count() == 0


def test_short_lines_that_many_share_stay(spark, make_docs, rng):
    line = "This page is free to copy. Keep this note. Thank you."
    texts = [f"{sentences(rng, 4)} {line} {sentences(rng, 4)}" for _ in range(30)]
    assert spans.shortened(make_docs(texts)).count() == 0


def test_recall_of_pasted_passages(spark, make_docs, rng):
    """Passages of over 50 words with edges anywhere: found wherever their whole pieces have the characters."""
    texts, whole = [], []
    for _ in range(60):
        cut = "".join(f"{words(rng, rng.randint(3, 14))}{rng.choice(', . ; '.split())} " for _ in range(9)).split()
        passage = " ".join(cut[rng.randint(0, 6) :][:58])
        texts += [f"{words(rng, 4)} {passage} {words(rng, 4)}." for _ in range(2)]
        inner = CUT.split(passage + " ")[1:-1]
        whole.append(sum(len(s.strip()) for s in inner) >= spans.MIN_CHARS)
    found = {r.doc_id for r in spans.shortened(make_docs(texts)).collect()}
    assert found >= {2 * k + 1 for k, w in enumerate(whole) if w} and np.mean(whole) > 0.95
    assert not any(d % 2 == 0 for d in found)
