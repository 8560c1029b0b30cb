"""Scores of a judged paper."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIORITIES = ("keep", "maybe", "drop")
#: Weights of overall fit, weighted dimensions and novelty in the rank score.
FIT, DIMENSIONS, NOVELTY = 0.45, 0.40, 0.15


def clamp(c: Column) -> Column:
    """To [0, 10], rounded to four places; NaN is 10, null is 0."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(c.cast("double"), F.lit(0.0)))), 4)


def priority(c: Column) -> Column:
    p = F.lower(F.trim(F.coalesce(c, F.lit("maybe"))))
    return F.when(p.isin(*PRIORITIES), p).otherwise("maybe")


def weighted_mean(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Mean over dimensions; weights below zero count as zero, and without any the mean is 0."""
    whole = sum(max(w, 0.0) for w in weights.values()) or 1.0
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + scores[k] * F.lit(max(float(w), 0.0))
    return total / F.lit(whole)


def blend(fit: Column, mean: Column, novelty: Column) -> Column:
    """The rank score before it is rounded."""
    return F.lit(FIT) * fit + F.lit(DIMENSIONS) * mean + F.lit(NOVELTY) * novelty


def rank_score(fit: Column, mean: Column, novelty: Column) -> Column:
    return F.round(blend(fit, mean, novelty), 4)


def _split(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two of half its digits each."""
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    return high, x - high


def round_exact(x: Column, digits: int) -> Column:
    """``x`` rounded half to even on the exact value of the double, as Python's ``round`` does.

    The product with 2 * 10 ** digits is taken without error, as a double and what that leaves out; it is
    compared with the odd number between the two candidates.  ``x`` is best a plain column, since it is named often.  NaN, infinities and doubles too large
    to have such a digit stay as they are.
    """
    if not 0 <= digits <= 10:
        raise ValueError("digits must be from 0 to 10")
    scale = 10.0**digits
    twice = F.lit(2 * scale)
    product = x * twice
    (a, b), (c, d) = _split(x), _split(twice)
    left = ((a * c - product) + a * d + b * c) + b * d
    lower = F.floor(product / 2).cast("double")
    # exact sign of (product + left) - (2 * lower + 1): the first difference has no error this near
    over = (product - (lower * 2 + 1)) + left
    whole = F.when(over > 0, lower + 1).when(over < 0, lower).otherwise(F.when(lower % 2 == 0, lower).otherwise(lower + 1))
    fits = F.abs(product) < F.lit(2.0**52)
    return F.when(~fits | F.isnan(x), x).otherwise(whole / F.lit(scale))
