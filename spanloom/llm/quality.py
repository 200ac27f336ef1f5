"""Quality classifier as a sparse ensemble of rules.

Small regression trees are boosted on statistics of labelled texts; every path from a root becomes a conjunctive rule; a logistic model
with an L1 penalty weighs the rules and leaves most at zero; the rest compile into one Spark column expression. Two ensembles share the
statistics: one for `quality`, one for `toxic`; a document is kept if the first says good and the second says clean. One statistic counts
words of a lexicon of toxic terms, which is learned from the same labels: the rows that rules are fitted on are counted with a lexicon of the other
half of the rows, so that no row vouches for its own words.

Scale: fitting takes at most `sample_rows` labelled rows (a documented bound: the least by a hash of the id, so the same at every run), and
happens on the driver over a matrix of so many rows and a dozen columns. Scoring is one narrow projection inside the JVM, over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, back, named

SAMPLE_ROWS, TREES, DEPTH, PENALTY, LEXICON_MIN_DOCS, LEXICON_ODDS = 8_000, 12, 3, 0.004, 5, 3.0
SYMBOLS = "#$%&*|<>{}=~^"


def statistics(text: Column, lexicon: list[str]) -> dict[str, Column]:
    """Statistics of a text by name, all doubles. Those that need the words read the columns __words and __distinct."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, distinct = F.col("__words"), F.col("__distinct")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")

    def share(chars: str) -> Column:
        return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)) / n

    letters = F.length(F.concat_ws("", distinct))
    toxic = F.size(F.array_intersect(distinct, F.array(*[F.lit(w) for w in lexicon]).cast("array<string>"))) if lexicon else F.lit(0)
    return {
        "log_chars": F.log(n),
        "symbol_share": share(SYMBOLS),
        "digit_share": share("0123456789"),
        "stop_share": share(".!?"),
        "comma_share": share(",;:"),
        "line_share": share("\n"),
        "words_per_char": n_words / n,
        "distinct_share": F.size(distinct) / n_words,
        "mean_distinct_length": letters / F.greatest(F.size(distinct), F.lit(1)),
        "bytes_per_char": F.octet_length(text) / n,
        "toxic_terms": toxic.cast("double"),
        "toxic_share": toxic / F.greatest(F.size(distinct), F.lit(1)),
    }


STATISTICS = ["log_chars", "symbol_share", "digit_share", "stop_share", "comma_share", "line_share", "words_per_char", "distinct_share", "mean_distinct_length", "bytes_per_char", "toxic_terms", "toxic_share"]


def split_words(text: Column) -> Column:
    """Lower-case words without the marks around them. Splitting on one blank is far faster than on a pattern."""
    flat = F.lower(F.coalesce(text, F.lit("")))
    for mark in "\n\t,.!?;:\"()":
        flat = F.replace(flat, F.lit(mark), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def with_statistics(df: DataFrame, lexicon: list[str]) -> DataFrame:
    """aside(df) with __filled, whether there is a text at all, and __s, the statistics of `text`.

    Generators stand between the steps, so that no statistic is worked out again where it is used.
    """
    text = F.coalesce(F.col(named(df, "text")), F.lit(""))
    once = aside(df).select("*", F.inline(F.array(F.struct(split_words(text).alias("__words")))))
    once = once.select("*", F.inline(F.array(F.struct(F.array_distinct("__words").alias("__distinct")))))
    stats = F.struct(*[c.cast("double").alias(k) for k, c in statistics(text, lexicon).items()])
    once = once.select("*", F.inline(F.array(F.struct(stats.alias("__s")))))
    return once.withColumn("__filled", F.trim(F.replace(text, F.lit("\n"), F.lit(" "))) != "").drop("__words", "__distinct")


@dataclass
class Rule:
    """A conjunction of (statistic, is above, threshold) with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, above, t in self.terms:
            value = F.col("__s")[STATISTICS[k]]
            out = out & ((value > F.lit(float(t))) if above else (value <= F.lit(float(t))))
        return F.when(out, F.lit(float(self.weight))).otherwise(F.lit(0.0))


@dataclass
class Ensemble:
    """Rules with weights and a bias: the probability of the label is the logistic of their sum."""

    bias: float
    rules: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(float(self.bias))
        for rule in self.rules:
            total = total + rule.column()
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x))))))


def _tree(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, least: int, out: list[tuple[tuple, np.ndarray]]) -> None:
    """Grow a least-squares tree; out gets every node's path and rows."""
    if path:
        out.append((path, rows))
    if depth == 0 or len(rows) < 2 * least:
        return
    y, best = target[rows], (1e-9, None, None)
    for k, points in enumerate(cuts):
        above = x[rows, k][:, None] > points[None, :]
        n = above.sum(0)
        ok = (n >= least) & (len(rows) - n >= least)
        if not ok.any():
            continue
        up = (above * y[:, None]).sum(0)
        gain = np.where(ok, up**2 / np.maximum(n, 1) + (y.sum() - up) ** 2 / np.maximum(len(rows) - n, 1) - y.sum() ** 2 / len(rows), -1)
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (gain[j], k, float(points[j]))
    _, k, t = best
    if k is None:
        return
    side = x[rows, k] > t
    for above in (False, True):
        _tree(x, target, cuts, rows[side == above], depth - 1, (*path, (k, above, t)), least, out)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, unknown: float = 1.0) -> Ensemble:
    """Boost trees on the logistic gradient, take their paths as rules, and weigh those by L1 logistic regression (FISTA)."""
    rate = float(np.clip(y.mean() if len(y) else unknown, 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Ensemble(base)
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, 33)[1:-1]))
        extreme = np.unique(np.quantile(x[:, k], [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]))
        cuts.append(np.unique(np.concatenate([values, extreme])))
    score, found, least = np.full(len(y), base), {}, max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes: list[tuple[tuple, np.ndarray]] = []
        _tree(x, y - p, cuts, np.arange(len(y)), depth, (), least, nodes)
        paths = {path for path, _ in nodes}
        for path, rows in nodes:
            found.setdefault(tuple(sorted(path)), None)
            if not any(len(q) > len(path) and q[: len(path)] == path for q in paths):  # a leaf
                score[rows] += 0.5 * (y - p)[rows].sum() / max((p * (1 - p))[rows].sum(), 1e-3)
    rules = [Rule(path) for path in found]
    z = np.stack([r.holds(x) for r in rules], 1).astype(float)
    scale = np.maximum(z.std(0), 0.05)
    w = v = np.zeros(len(rules))
    b = vb = base
    t = 1.0
    step = 4 / (np.linalg.norm(np.c_[z / scale, np.ones(len(y))], 2) ** 2 / len(y))
    for _ in range(400):
        g = 1 / (1 + np.exp(-((z / scale) @ v + vb))) - y
        new = v - step * ((z / scale).T @ g) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = vb - step * g.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, vb = new + (before - 1) / t * (new - w), nb + (before - 1) / t * (nb - b)
        w, b = new, nb
    return Ensemble(float(b), [Rule(r.terms, float(wk / s)) for r, wk, s in zip(rules, w, scale) if abs(wk) > 1e-4])


@dataclass
class Model:
    quality: Ensemble
    toxic: Ensemble
    lexicon: list[str]


def _lexicon(words: DataFrame, totals: list[tuple[int, int]], min_docs: int, odds: float) -> list[list[str]]:
    """The toxic terms of half 0, of half 1 and of all rows. words: (w, half, toxic); totals: (toxic rows, rows) of both halves."""
    per = words.groupBy("w").agg(*[F.sum(F.when(F.col("half") == h, x)).alias(f"{n}{h}") for h in (0, 1) for n, x in (("bad", F.col("toxic")), ("n", F.lit(1)))])
    per = per.fillna(0).where(F.col("bad0") + F.col("bad1") >= min_docs)
    totals = [*totals, (totals[0][0] + totals[1][0], totals[0][1] + totals[1][1])]
    seen = [(F.col("bad0"), F.col("n0")), (F.col("bad1"), F.col("n1")), (F.col("bad0") + F.col("bad1"), F.col("n0") + F.col("n1"))]
    chosen = []
    for (b, n), (all_bad, all_n) in zip(seen, totals):
        ratio = F.log((b + 0.5) / (all_bad + 1.0)) - F.log((n - b + 0.5) / (all_n - all_bad + 1.0))
        chosen.append((b >= min_docs) & (ratio > odds) if 0 < all_bad < all_n else F.lit(False))
    rows = per.select("w", *[c.alias(f"c{k}") for k, c in enumerate(chosen)]).where("c0 OR c1 OR c2").collect()
    return [sorted(r["w"] for r in rows if r[f"c{k}"]) for k in range(3)]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon_min_docs: int = LEXICON_MIN_DOCS, lexicon_odds: float = LEXICON_ODDS) -> Model:
    """Fit both ensembles on the labelled documents, at most sample_rows of them, those with the least hash of doc_id.

    A word is a toxic term if lexicon_min_docs toxic rows have it and its logarithmic odds of standing in one exceed lexicon_odds; there is no limit on
    their number but what sample_rows rows hold.

    Rows with a null id, text or label, and ids that docs lacks, are passed over. A label with one value only, or no labels at all, gives an
    ensemble without rules; without labels every text is good and clean.
    """
    few = labels.select("doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(few), "doc_id").select("text", "quality", "toxic", half)
    words = texts.select(F.explode(F.array_distinct(split_words(F.col("text")))).alias("w"), "half", "toxic")
    sizes = {r["half"]: (int(r["bad"] or 0), r["n"]) for r in texts.groupBy("half").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()}
    first, second, lexicon = _lexicon(words, [sizes.get(h, (0, 0)) for h in (0, 1)], lexicon_min_docs, lexicon_odds)
    got = [r for h, other in ((0, second), (1, first)) for r in with_statistics(texts.where(F.col("half") == h).select("text", "quality", "toxic"), other).select("__c1", "__c2", "__s.*").collect()]
    data = np.array([[float(v) for v in r] for r in got]).reshape(-1, 2 + len(STATISTICS))
    order = np.lexsort(data.T)
    data = data[order]
    return Model(fit(data[:, 2:], data[:, 0]), fit(data[:, 2:], data[:, 1], unknown=0.0), lexicon)


def _verdict(docs: DataFrame, model: Model) -> DataFrame:
    return with_statistics(docs, model.lexicon).withColumns({"__good": model.quality.column(), "__toxic": model.toxic.column()})


def _kept() -> Column:
    return (F.col("__good") >= 0.5) & (F.col("__toxic") < 0.5) & F.col("__filled")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep) of every row; a null or blank text isn't kept. Repeated rows are scored alike."""
    return _verdict(docs.select("doc_id", "text"), model).select(F.col("__c0").alias("doc_id"), F.col("__good").alias("p_quality"), F.col("__toxic").alias("p_toxic"), _kept().alias("keep"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs, with all its columns, without the rows that score() doesn't keep."""
    return back(_verdict(docs, model).where(_kept()), docs)
