"""The one-sided two-proportion test that tells a regression from noise."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def critical_value(confidence: float) -> float:
    return NormalDist().inv_cdf(min(max(confidence, 1e-6), 1 - 1e-6))


def significant_regression(p_base: Column, n_base: Column, p_cand: Column, n_cand: Column, confidence: float) -> Column:
    """Whether the candidate's proportion is below the baseline's beyond chance.

    Without trials or without spread nothing can be excused, so both are true. Rounded counts enter the pooled variance only.
    """
    some = (n_base > 0) & (n_cand > 0)
    nb, nc = (F.when(some, n).otherwise(F.lit(1)).cast("double") for n in (n_base, n_cand))
    pooled = (F.bround(p_base * nb, 0) + F.bround(p_cand * nc, 0)) / (nb + nc)
    variance = pooled * (1 - pooled) * (1 / nb + 1 / nc)
    z = (p_base - p_cand) / F.sqrt(F.when(variance > 0, variance).otherwise(F.lit(1.0)))
    return F.when(~some, True).when(p_cand >= p_base, False).when(variance <= 0, True).otherwise(z > F.lit(critical_value(confidence)))
