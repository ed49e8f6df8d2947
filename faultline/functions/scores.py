"""Risk and severity arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, saturation and band thresholds of the composite score.
WEIGHTS = {"reach": 0.40, "window": 0.25, "maintainer": 0.20, "typosquat": 0.15}
REACH_SATURATION = 60
BANDS = ((0.75, "critical"), (0.50, "high"), (0.25, "moderate"))
RISK_DEFAULT, RISK_BUMP, RISK_CAP, RISK_MALICIOUS = 0.05, 0.15, 0.9, 1.0
SEVERITY_ORDER = ("critical", "high", "warning", "info")


def reach_component(dependents: Column) -> Column:
    top = F.log10(F.lit(1.0 + REACH_SATURATION))
    return F.least(F.lit(1.0), F.log10(F.lit(1.0) + dependents) / top)


def maintainer_component(flagged: Column, total: Column) -> Column:
    share = F.when(total > 0, 0.5 * flagged / total).otherwise(F.lit(0.0))
    return F.when(flagged > 0, F.least(F.lit(1.0), 0.5 + share)).otherwise(F.lit(0.0))


def typosquat_component(similarity: Column, count: Column) -> Column:
    extra = F.least(F.lit(0.05), 0.01 * (count - 1))
    base = F.coalesce(similarity, F.lit(0.0))
    return F.when(count > 1, F.least(F.lit(1.0), base + extra)).otherwise(base)


def composite(reach: Column, window: Column, maintainer: Column, typosquat: Column) -> Column:
    total = (
        WEIGHTS["reach"] * reach
        + WEIGHTS["window"] * window
        + WEIGHTS["maintainer"] * maintainer
        + WEIGHTS["typosquat"] * typosquat
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def band(score: Column) -> Column:
    out = F.lit("low")
    for threshold, name in reversed(BANDS):
        out = F.when(score >= threshold, name).otherwise(out)
    return out


def exposure_severity(percentage: Column, tier1: Column) -> Column:
    return (
        F.when(percentage <= 0, "CONTAINED")
        .when((tier1 > 0) & (percentage >= 25), "CRITICAL")
        .when(percentage >= 60, "CRITICAL")
        .when(percentage >= 25, "SEVERE")
        .when(percentage >= 10, "ELEVATED")
        .otherwise("LIMITED")
    )


def share_percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * part / total, 1)).otherwise(F.lit(0.0))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), severity)
