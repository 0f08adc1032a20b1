"""Percentile and score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import HIGHER, LOWER, TWO_SIDED, Criterion


def mid_rank(n_lower, n_equal, n_total) -> Column:
    """(#{r < x} + half #{r = x}) / m."""
    return (n_lower + F.lit(0.5) * n_equal) / n_total


def one_sided_score(p: Column, mode: str) -> Column:
    return p if mode == HIGHER else F.lit(1.0) - p


def two_sided_score(p: Column) -> Column:
    """1 at the reference median, 0 at either tail."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.lit(2.0) * F.abs(p - F.lit(0.5))))


def score_for(p: Column, mode: str) -> Column:
    return two_sided_score(p) if mode == TWO_SIDED else one_sided_score(p, mode)


def score_by_mode(p: Column, mode: Column) -> Column:
    """Same, with the mode read from a column."""
    return (
        F.when(mode == TWO_SIDED, two_sided_score(p))
        .when(mode == LOWER, F.lit(1.0) - p)
        .when(mode == HIGHER, p)
    )


def weighted_mean(scores: dict[str, Column], criteria) -> Column:
    """Sum of w*s over sum of w. Every score needs a declared weight."""
    weights = {c.name: c.weight for c in criteria}
    undeclared = sorted(set(scores) - set(weights))
    if undeclared:
        raise ValueError(f"no weight declared for criteria: {undeclared}")
    used = [n for n in scores if weights[n] > 0]
    if not used:
        raise ValueError("no criterion has a positive weight")
    total = sum(weights[n] for n in used)
    acc = None
    for n in used:
        term = scores[n] * F.lit(float(weights[n]))
        acc = term if acc is None else acc + term
    return acc / F.lit(float(total))


def finite_or_fail(value: Column, label: str) -> Column:
    """The value, or an error: a NaN would silently become an extreme percentile."""
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"non-finite value in {label}")).cast("double")).otherwise(v)


def is_finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


__all__ = ["mid_rank", "one_sided_score", "two_sided_score", "score_for", "score_by_mode",
           "weighted_mean", "finite_or_fail", "is_finite", "Criterion"]
