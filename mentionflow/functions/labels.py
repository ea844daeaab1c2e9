"""Labels, score buckets and prediction predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower and upper edge of the neutral band, and the binary cut-off.
NEUTRAL_FROM = 2.0
NEUTRAL_TO = 2.05
CUTOFF = 2.0

SYMBOLS = ("-", "=", "+")
WORDS = ("negative", "neutral", "positive")


def to_symbol(label: Column) -> Column:
    """``pos…`` is ``+``, ``neg…`` is ``-``, anything else is ``=``; case is ignored."""
    low = F.lower(label)
    return (
        F.when(F.startswith(low, F.lit("pos")), "+")
        .when(F.startswith(low, F.lit("neg")), "-")
        .otherwise("=")
    )


def bucket(
    score: Column,
    names: tuple[str, str, str] = SYMBOLS,
    low: float = NEUTRAL_FROM,
    high: float = NEUTRAL_TO,
    strict_reference: bool = False,
) -> Column:
    """Three-way bucket of a score.

    A text without sentences has no score and no bucket; ``strict_reference`` puts it into
    the highest bucket, which is where a NaN score ends up. ``low`` equal to ``high`` leaves
    no neutral band.
    """
    negative, neutral, positive = names
    known = (
        F.when(F.isnan(score), positive)
        .when(score < low, negative)
        .when(score < high, neutral)
        .when(score >= high, positive)
    )
    return F.coalesce(known, F.lit(positive)) if strict_reference else known


def predicted_positive(score: Column, cutoff: float = CUTOFF) -> Column:
    """NaN counts as neither positive nor negative."""
    return (score > cutoff) & ~F.isnan(score)


def predicted_negative(score: Column, cutoff: float = CUTOFF) -> Column:
    return (score <= cutoff) & ~F.isnan(score)
