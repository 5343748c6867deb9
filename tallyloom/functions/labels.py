"""Thresholds turned into words, bins and guarded arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and the words they stand for.
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
EFFECT_WORDS = ((0.8, "Large"), (0.5, "Medium"), (0.2, "Small"))
CORRELATION_EFFECT_WORDS = ((0.5, "Large"), (0.3, "Medium"), (0.1, "Small"))
CORRELATION_STRENGTHS = ((0.7, "Strong"), (0.3, "Moderate"))
ETA_WORDS = ((0.14, "Large"), (0.06, "Medium"))
QUALITY_LEVELS = ((90, "excellent"), (75, "good"), (60, "fair"))


def at_least(value: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Word of the first step the value reaches."""
    out = F
    for limit, word in steps:
        out = out.when(value >= limit, word)
    return out.otherwise(otherwise)


def stars(p: Column) -> Column:
    out = F
    for limit, word in STARS:
        out = out.when(p < limit, word)
    return out.otherwise("ns")


def effect_word(d: Column) -> Column:
    return at_least(F.abs(d), EFFECT_WORDS, "Negligible")


def correlation_effect_word(r: Column) -> Column:
    return at_least(F.abs(r), CORRELATION_EFFECT_WORDS, "Negligible")


def correlation_strength(r: Column) -> Column:
    return at_least(F.abs(r), CORRELATION_STRENGTHS, "Weak")


def eta_word(eta: Column) -> Column:
    return at_least(eta, ETA_WORDS, "Small")


def quality_level(score: Column) -> Column:
    return at_least(score, QUALITY_LEVELS, "poor")


def right_closed_bin(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the bin ``(edges[i], edges[i+1]]`` the value falls in, else null."""
    out = F
    for low, high, name in zip(edges, edges[1:], names):
        out = out.when((value > low) & (value <= high), name)
    return out.otherwise(F.lit(None).cast("string"))


def log2_fold_change(a: Column, b: Column) -> Column:
    """Defined only where both means are positive."""
    return F.when((a > 0) & (b > 0), F.log2(a / b))


def guarded_ratio(a: Column, b: Column, epsilon: float = 1e-6, floor: float = 1e-9) -> Column:
    """``(a+e)/(b+e)``, infinite where ``b`` is practically zero."""
    return F.when(F.abs(b) > floor, (a + epsilon) / (b + epsilon)).otherwise(F.lit(float("inf")))
