import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import quality
from tests.llm.conftest import sentences, words


def corpus(rng, n):
    rows, labels = [], []
    for k in range(n):
        kind = rng.choice(["good", "good", "symbols", "stutter", "toxic"])
        text = sentences(rng, 12)
        if kind == "symbols":
            text = " ".join(w + "###" for w in text.split())
        elif kind == "stutter":
            text = (words(rng, 1) + " ") * 120
        elif kind == "toxic":
            w = text.split()
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["blarg", "zonk!"])
            text = " ".join(w)
        rows.append((k, text))
        labels.append((k, int(kind in ("good", "toxic")), int(kind == "toxic")))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy_and_compiled_rules(spark, make_docs, rng):
    rows, labels = corpus(rng, 900)
    docs = make_docs(rows).cache()
    model = quality.train(docs, spark.createDataFrame(labels[:500], LABELS))
    assert {"blarg", "zonk"} <= set(model.lexicon)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    right = [got[k].keep == bool(q and not t) for k, q, t in labels[500:]]
    assert np.mean(right) > 0.97
    stats = quality.with_statistics(docs, model.lexicon).select(F.col("__c0").alias("doc_id"), "__s.*").collect()
    x = np.array([[float(v) for v in r[1:]] for r in stats])
    assert np.allclose(model.quality.predict(x), [got[r.doc_id].p_quality for r in stats])
    assert np.allclose(model.toxic.predict(x), [got[r.doc_id].p_toxic for r in stats])
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {k for k, r in got.items() if r.keep}


def test_lasso_leaves_few_rules():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) < len(quality.fit(x, y, penalty=0.0).rules) / 2
    assert ((model.predict(x) > 0.5) == y).mean() > 0.97


def test_edges(spark, make_docs, rng):
    rows, labels = corpus(rng, 200)
    docs = make_docs([*rows, (None, sentences(rng, 12)), (500, None), (501, ""), (502, "  \n"), (503, sentences(rng, 9000)), rows[0]], extra=("quality", "__s", "__words"))
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 1), (9999, 1, 0), labels[0]], LABELS)
    model = quality.train(docs, marks)
    got = quality.score(docs, model)
    assert got.count() == 206 and got.where("doc_id IN (500, 501, 502) AND keep").count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where(F.col("__s") != "mine").count() == 0
    assert quality.keep_good(docs.limit(0), model).count() == 0
    for some, none in ((docs, marks.limit(0)), (docs, marks.where("quality = 1 AND toxic = 0")), (docs.limit(0), marks)):
        plain = quality.train(some, none)
        assert not plain.quality.rules and not plain.toxic.rules
        assert quality.score(docs, plain).where("keep").count() == 203


def by_hand(text, lexicon):
    """The statistics in plain Python."""
    text = text or ""
    flat = text.lower()
    for mark in "\n\t,.!?;:\"()":
        flat = flat.replace(mark, " ")
    said = [w for w in flat.split(" ") if w]
    distinct, n, n_words = set(said), max(len(text), 1), max(len(said), 1)
    share = lambda marks: sum(text.count(m) for m in marks) / n
    bad = len(distinct & set(lexicon))
    return [np.log(n), share(quality.SYMBOLS), share("0123456789"), share(".!?"), share(",;:"), share("\n"), n_words / n, len(distinct) / n_words, sum(map(len, distinct)) / max(len(distinct), 1), len(text.encode()) / n, bad, bad / max(len(distinct), 1)]


def test_statistics_by_hand(spark, make_docs, rng):
    texts = [sentences(rng, 5), "Ün Dé! 12\t#$%^~ (a;b:c) \"q\"\n\nzonk, blarg blarg", "", None, "x" * 9000, "WORD word, Word"]
    for lexicon in ([], ["zonk", "blarg", "absent"]):
        got = quality.with_statistics(make_docs(texts), lexicon).select(F.col("__c0").alias("k"), "__s.*").collect()
        for r in got:
            assert np.allclose([float(v) for v in r[1:]], by_hand(texts[r.k], lexicon)), texts[r.k]


def test_lasso_weights_are_the_optimum():
    """At the minimum of loss + penalty the gradient is the penalty for weights in use and no larger for the others, which is checked rule by rule."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, len(quality.STATISTICS)))
    y = ((x[:, 1] > 0.3) | (x[:, 2] < -1)).astype(float)
    model = quality.fit(x, y, penalty=0.01)
    off = model.predict(x) - y
    assert abs(off.mean()) < 1e-3 and model.rules
    for rule in model.rules:
        held = rule.holds(x).astype(float)
        pull = (held * off).mean() / max(held.std(), 0.05)
        assert abs(pull + 0.01 * np.sign(rule.weight)) < 2e-3


def test_no_row_vouches_for_its_own_words(spark, make_docs, rng):
    """Each toxic text of these has a word of its own five times over; none is a term, as no other row has it."""
    rows = [(k, sentences(rng, 8) + (f" own{k}" * 5 if k % 4 == 0 else "")) for k in range(300)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(300)]
    model = quality.train(make_docs(rows), spark.createDataFrame(labels, LABELS))
    assert model.lexicon == [] and (model.toxic.predict(np.zeros((1, len(quality.STATISTICS)))) < 0.5).all()
