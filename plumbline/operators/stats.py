"""Rank statistics, intervals and summaries, per group and in one pass each."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import is_finite
from .ordering import average_rank, group_quantiles, prefix_counts, wants_spread


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= t) with df degrees of freedom."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a rank correlation, one row per group."""
    def one(r, m):
        if pd.isna(r) or m < 3:
            return None
        if abs(r) >= 1.0:
            return 0.0
        return t_two_sided(r * math.sqrt((m - 2) / (1 - r * r)), m - 2)
    return pd.Series([one(r, m) for r, m in zip(rho, n)], dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else min(1.0, math.erfc(v / math.sqrt(2))) for v in z], dtype=float)


def correlation(x: str, y: str):
    """Pearson's correlation as an aggregate; null, not an error, where a side does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, spread=None) -> DataFrame:
    """(keys, n, rho, p_value, reason, interpretation): Pearson of average ranks."""
    pairs = df.filter(is_finite(F.col(x)) & is_finite(F.col(y))).select(
        *keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    spread = wants_spread(df, spread, keys)
    ranked = average_rank(pairs, keys, "__x", "__rx", spread=spread)
    ranked = average_rank(ranked, keys, "__y", "__ry", spread=spread)
    stats = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), correlation("__rx", "__ry").alias("c"),
        F.min("__x").alias("x0"), F.max("__x").alias("x1"), F.min("__y").alias("y0"), F.max("__y").alias("y1"))
    every = df.select(*keys).distinct().join(stats, keys, "left") if keys else stats
    flat = (F.coalesce("n", F.lit(0)) < 3) | (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    rho = F.when(~flat, F.col("c"))
    out = every.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), rho.alias("rho"))
    out = out.withColumn("p_value", correlation_p("rho", "n"))
    return out.withColumns({
        "reason": F.when(F.col("rho").isNull(), "insufficient variation or fewer than 3 evaluated survivors"),
        "interpretation": F.when(F.abs("rho") > 0.7, "the two tiers order the candidates alike").when(
            F.col("rho").isNotNull(), "the two tiers order the candidates differently")})


def mann_whitney(df: DataFrame, keys: list[str], value: str, positive: str, spread=None) -> DataFrame:
    """U, AUC (ties half), medians and p-value of positives against the rest.

    Values are first counted per (group, value), so ranking works on distinct
    values. p uses the tie-corrected normal approximation with continuity.
    """
    ok = df.filter(is_finite(F.col(value)))
    spread = wants_spread(df, spread)
    counts = ok.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.count_if(F.col(positive)).alias("pos"), F.count_if(~F.col(positive)).alias("neg"))
    return mann_whitney_counts(counts, keys, df.select(*keys).distinct() if keys else None, spread)


def mann_whitney_counts(counts: DataFrame, keys: list[str], every: DataFrame | None = None,
                        spread=None, weights=("pos", "neg")) -> DataFrame:
    """The same from (keys, v, pos, neg) counts."""
    pos, neg = weights
    run = prefix_counts(counts, keys, "v", [pos, neg], spread)
    t = F.col(pos) + F.col(neg)
    total_p, total_n = F.col(f"{pos}_total"), F.col(f"{neg}_total")

    def median(c):
        before, here, total = F.col(f"{c}_before"), F.col(c), F.col(f"{c}_total")
        lo, hi = F.floor((total - 1) / 2), F.floor(total / 2)
        def at(k):
            return F.max(F.when((before <= k) & (k < before + here), F.col("v")))
        return (at(lo) + at(hi)) / 2

    stats = run.groupBy(*keys).agg(
        F.max(total_p).alias("n_a"), F.max(total_n).alias("n_b"),
        F.sum(F.col(pos).cast("double") * (F.col(f"{neg}_before") + F.lit(0.5) * F.col(neg))).alias("u"),
        F.sum(t.cast("double") * t * t - t).alias("ties"), median(pos).alias("median_a"), median(neg).alias("median_b"))
    out = every.join(stats, keys, "left") if every is not None else stats
    na, nb = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    few = (na < 2) | (nb < 2)
    n = na + nb
    mean = na * nb / F.lit(2.0)
    var = na * nb / F.lit(12.0) * ((n + 1) - F.col("ties") / F.nullif((n * (n - 1)).cast("double"), F.lit(0.0)))
    z = (F.abs(F.col("u") - mean) - F.lit(0.5)) / F.sqrt(F.when(var > 0, var))
    some = lambda c: F.when(~few, c)
    out = out.select(
        *keys, na.alias("n_a"), nb.alias("n_b"), some(F.col("median_a")).alias("median_a"),
        some(F.col("median_b")).alias("median_b"), some(F.col("u")).alias("u_statistic"),
        some(F.col("u") / F.nullif((na * nb).cast("double"), F.lit(0.0))).alias("auc"), some(z).alias("__z"),
        F.when(few, "fewer than two observations in a group").alias("reason"))
    return out.withColumn("p_value", normal_two_sided("__z")).drop("__z")


def auc(df: DataFrame, keys: list[str], value: str, positive: str, spread=None) -> DataFrame:
    """(keys, n_a, n_b, auc): probability that a positive outranks a negative."""
    return mann_whitney(df, keys, value, positive, spread).select(*keys, "n_a", "n_b", "auc")


def retrieval_metrics(scores: DataFrame, unit: str, score: str, is_true: str, keys: list[str] = ()) -> DataFrame:
    """MRR and top-1 rate: where the true score stands among its decoys.

    The true score of a unit is spread over its rows by a window; a unit with a
    missing score or without decoys is left out.
    """
    keys = list(keys)
    own = scores.groupBy(*keys, unit).agg(
        F.max(F.when(F.col(is_true), F.col(score))).alias("__t"),
        F.count(F.lit(1)).alias("__n"), F.count_if(~is_finite(F.col(score))).alias("__bad"))
    own = own.filter((F.col("__bad") == 0) & (F.col("__n") >= 2) & F.col("__t").isNotNull())
    rank = scores.filter(~F.col(is_true)).join(own, [*keys, unit]).groupBy(*keys, unit).agg(
        (F.lit(1.0) + F.count_if(F.col(score) > F.col("__t")) + F.lit(0.5) * F.count_if(F.col(score) == F.col("__t"))).alias("__r"))
    return rank.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.lit(1.0) / F.col("__r")).alias("mrr"),
        F.avg((F.col("__r") == 1).cast("double")).alias("top1_accuracy"))


def wilson_bounds(successes, n, z: float = 1.96):
    """(low, high) columns of the Wilson interval, null for n = 0."""
    n = F.when(n > 0, n).cast("double")
    p = successes / n
    zz = F.lit(z * z)
    denom = F.lit(1.0) + zz / n
    centre = (p + zz / (2 * n)) / denom
    margin = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / denom
    clip = lambda c: F.when(n.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return clip(centre - margin), clip(centre + margin)


def group_quartiles(df: DataFrame, keys: list[str], value: str, spread=None) -> DataFrame:
    return group_quantiles(df, keys, value, {"q1": .25, "median": .5, "q3": .75}, spread, n="n")


def letter_frequencies(df: DataFrame, keys: list[str] = (), seq: str = "sequence") -> DataFrame:
    """Pooled letter shares of all sequences."""
    def count(c):
        return F.sum(F.length(seq) - F.length(F.translate(F.col(seq), c, ""))).alias(c)
    total = F.col("A") + F.col("C") + F.col("G") + F.col("U")
    return df.groupBy(*keys).agg(*[count(c) for c in "ACGU"]).select(
        *keys, *[(F.col(c) / F.nullif(total, F.lit(0))).alias(f"freq_{c}") for c in "ACGU"])


def length_distribution(df: DataFrame, keys: list[str] = (), seq: str = "sequence") -> DataFrame:
    return df.groupBy(*keys, F.length(seq).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def descriptor_report(df: DataFrame, size: str = "rg_median_A", length: str = "length", spread=None) -> DataFrame:
    """One row: ranges, correlation of size with length, spread among equal lengths."""
    spread = wants_spread(df, spread)
    ok = df.filter(is_finite(F.col(size)) & is_finite(F.col(length))).withColumn("__one", F.lit(0))
    base = ok.groupBy("__one").agg(
        F.count(F.lit(1)).alias("n"), correlation(size, length).alias("correlation"),
        *[f(c).alias(f"{n}_{c}") for c in (size, length) for f, n in ((F.min, "min"), (F.max, "max"))])
    for c in (size, length):
        base = base.join(group_quantiles(ok, ["__one"], c, {f"median_{c}": .5}, spread), "__one")
    within = ok.groupBy(length, "__one").agg(F.count(F.lit(1)).alias("__n"), F.stddev_pop(size).alias("sd"))
    within = within.filter(F.col("__n") > 2).groupBy("__one").agg(
        F.median("sd").alias("median_sd_within_length"), F.max("sd").alias("max_sd_within_length"))
    return base.join(within, "__one", "left").drop("__one")


def band_agreement(df: DataFrame, keys: list[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """Band counts under two models and the share of equal bands; a row counts ``weight`` times."""
    bands = ("strong", "moderate", "weak")
    w = F.col(weight) if weight else F.lit(1).cast("long")
    times = lambda c: F.sum(F.when(c, w).otherwise(F.lit(0).cast("long")))
    same = F.col(a) == F.col(b)
    return df.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        *[times(F.col(c) == x).alias(f"{x}_{c}") for c in (a, b) for x in bands],
        (times(same).cast("double") / F.sum(F.when(same.isNotNull(), w))).alias("agreement"))


__all__ = ["spearman", "mann_whitney", "mann_whitney_counts", "auc", "retrieval_metrics", "wilson_bounds",
           "group_quartiles", "letter_frequencies", "length_distribution", "descriptor_report", "band_agreement",
           "Window"]
