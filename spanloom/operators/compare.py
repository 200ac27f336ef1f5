"""Scorecards against each other: two at a time with a significance test, or along an ordered ladder.

A scorecard is rows (lock_id, capability, score); many scorecards compare in one plan. Presence is a flag of its own, not a null score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import significant_regression

MAX_DROP = 0.05


def diff(baseline: DataFrame, candidate: DataFrame, max_drop: float = MAX_DROP, confidence: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, capability, baseline, candidate, delta, significant, status) of (keys, capability, score[, trials]) on both sides.

    A drop beyond max_drop is a regression, or noisy where a confidence is given and the drop isn't significant. Thresholds are strict, after
    rounding to four places. What is new never fails; what is gone always does.
    """
    on = [*keys, "capability"]
    side = lambda df, c: df.select(*on, F.col("score").alias(c), (F.col("trials") if "trials" in df.columns else F.lit(0)).alias(f"n_{c}"), F.lit(True).alias(f"has_{c}"))
    both = side(baseline, "baseline").join(side(candidate, "candidate"), on, "full_outer")
    delta = F.bround(F.col("candidate") - F.col("baseline"), 4)
    fell = F.col("delta") < -max_drop
    test = significant_regression(F.col("baseline"), F.col("n_baseline"), F.col("candidate"), F.col("n_candidate"), confidence) if confidence else F.lit(None).cast("boolean")
    status = (
        F.when(F.col("has_baseline").isNull(), "added")
        .when(F.col("has_candidate").isNull(), "removed")
        .when(fell & F.coalesce(F.col("significant"), F.lit(True)), "regression")
        .when(fell, "noisy")
        .when(F.col("delta") > max_drop, "improved")
        .otherwise("ok")
    )
    out = both.withColumn("delta", delta).withColumn("significant", F.when(F.col("delta") < -max_drop, test))
    return out.withColumn("status", status).select(*on, "baseline", "candidate", "delta", "significant", "status")


def failed(status: Column) -> Column:
    return status.isin("regression", "removed")


def gate(rows: DataFrame, same_model: bool | None = None, require_same_model: bool = False) -> int:
    """2 for a comparison that isn't allowed, which comes first, 1 for a regression, 0 otherwise."""
    if require_same_model and not same_model:
        return 2
    return int(rows.where(failed(F.col("status"))).limit(1).count() > 0)


def changed(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(tools_changed, traces_changed) of two one-row metadata tables."""
    b, c = (m.select(F.col("tools_fingerprint").alias(f"{p}_tools"), F.col("traces_fingerprint").alias(f"{p}_traces")) for m, p in ((baseline, "b"), (candidate, "c")))
    return b.crossJoin(c).select((~F.col("b_tools").eqNullSafe(F.col("c_tools"))).alias("tools_changed"), (~F.col("b_traces").eqNullSafe(F.col("c_traces"))).alias("traces_changed"))


def trend(rungs: DataFrame, n_rungs: int, max_drop: float = MAX_DROP, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, capability, values, delta, worst_step, monotonic, status) of (keys, capability, pos, score), pos from 0.

    Steps run between rungs that are present. In this order: removed if the last is absent but an earlier one isn't, partial with fewer than two,
    regressed or improved by first against last, unstable if a step falls beyond max_drop, stable.
    """
    on = [*keys, "capability"]
    order = Window.partitionBy(*on).orderBy("pos")
    steps = rungs.withColumn("step", F.bround(F.col("score") - F.lag("score").over(order), 4))
    at = F.map_from_entries(F.collect_list(F.struct("pos", "score")))
    each = steps.groupBy(*on).agg(
        at.alias("at"), F.min_by("score", "pos").alias("first"), F.max_by("score", "pos").alias("last"), F.max("pos").alias("top"), F.count("*").alias("n"),
        F.min("step").alias("worst_step"), (F.coalesce(F.bool_and(F.col("step") <= 0), F.lit(True)) | F.coalesce(F.bool_and(F.col("step") >= 0), F.lit(True))).alias("monotonic"),
    )
    enough = F.col("n") >= 2
    delta = F.when(enough, F.bround(F.col("last") - F.col("first"), 4))
    status = (
        F.when(F.col("top") < n_rungs - 1, "removed")
        .when(~enough, "partial")
        .when(F.col("delta") < -max_drop, "regressed")
        .when(F.col("delta") > max_drop, "improved")
        .when(F.col("worst_step") < -max_drop, "unstable")
        .otherwise("stable")
    )
    values = F.transform(F.sequence(F.lit(0), F.lit(n_rungs - 1)), lambda k: F.try_element_at("at", k))
    out = each.withColumn("delta", delta).withColumn("status", status)
    return out.select(*on, values.alias("values"), "delta", F.when(enough, F.col("worst_step")).alias("worst_step"), "monotonic", "status")


def trials(results: DataFrame, samples: Column) -> DataFrame:
    """(capability, trials): results times samples, those that failed included."""
    return results.groupBy("capability").agg((F.count("*") * F.greatest(F.max(samples), F.lit(1))).alias("trials"))


def notes(baseline: dict, candidate: dict, families: tuple[str, str], errored: dict[str, dict[str, tuple[int, int]]] | None = None) -> list[str]:
    """What a reader must know before trusting a comparison of two scorecards' metadata. errored: by side and capability, how many of how many checks
    about not doing something failed as requests."""
    out = []
    if baseline.get("tools_fingerprint") != candidate.get("tools_fingerprint"):
        out.append("The toolsets differ, so scores of the same name measure different checks.")
    if baseline.get("traces_fingerprint") != candidate.get("traces_fingerprint"):
        out.append("The recorded checks differ.")
    variant = lambda m: "/".join(str(m[k]) for k in ("model", "quant", "runtime") if m.get(k))
    if baseline.get("model") and candidate.get("model") and families[0] != families[1]:
        out.append(f"The models are of different families: {families[0]} and {families[1]}.")
    elif baseline.get("model") and variant(baseline) != variant(candidate):
        out.append(f"One model, two variants: {variant(baseline)} and {variant(candidate)}.")
    if baseline.get("samples") != candidate.get("samples"):
        out.append(f"Sample counts differ: {baseline.get('samples')} and {candidate.get('samples')}.")
    for side, found in (errored or {}).items():
        out += [f"Of the {side}'s {total} checks of {capability}, {bad} failed as requests, which counts as not doing it." for capability, (bad, total) in sorted(found.items())]
    return out


def trend_notes(cards: list[dict], families: list[str]) -> list[str]:
    """The same for a ladder of scorecards' metadata."""
    out = []
    several = lambda key: len({c[key] for c in cards if c.get(key)}) > 1
    if several("tools_fingerprint"):
        out.append("The toolsets differ along the ladder.")
    if several("traces_fingerprint"):
        out.append("The recorded checks differ along the ladder.")
    named = sorted({f for c, f in zip(cards, families) if c.get("model")})
    if len(named) > 1:
        out.append(f"The ladder mixes models of different families: {', '.join(named)}.")
    if len({c.get("samples") for c in cards}) > 1:
        out.append("Sample counts differ along the ladder, so its steps tell with different certainty.")
    return out
