"""Metrics as column expressions over plain columns and arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a default account name looks like.
DEFAULT_USERNAME = r"^[A-Z][a-z]+[-_]?[A-Z][a-z0-9]+[-_]?\d{2,6}$"
LOG10_BINS = 10


def base36(text: Column) -> Column:
    """Base-36 number of a text of 1 to 12 digits and letters; null otherwise."""
    return F.when(F.rlike(text, F.lit("^[0-9A-Za-z]{1,12}$")), F.conv(text, 36, 10).cast("bigint"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def gini(values: Column) -> Column:
    """2 sum(i x_i) / (n S) - (n + 1) / n of the sorted values; null for fewer than 2 or a sum of 0."""
    a = F.sort_array(values.cast("array<double>"))
    n, s = F.size(a), _total(a)
    weighted = _total(F.transform(a, lambda x, i: x * (i + 1)))
    return F.when((n >= 2) & (s != 0), 2 * weighted / (n * s) - (n + 1) / n)


def nearest_rank(values: Column, q: float) -> Column:
    """Element round(q (n - 1)), half to even, of the sorted values; null for none."""
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), (F.bround(F.lit(q) * (F.size(values) - 1)) + 1).cast("int")))


def gaps(times: Column) -> Column:
    """Differences between neighbours of an ascending array."""
    n = F.size(times)
    return F.when(n > 1, F.zip_with(F.slice(times, 2, F.greatest(n - 1, F.lit(0))), F.slice(times, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)).otherwise(F.array().cast("array<bigint>"))


def interval_entropy(gap: Column, bins: int = LOG10_BINS) -> Column:
    """Entropy of the positive gaps over equal bins of log10 from the least to the greatest + 1, divided by log2(bins). Null for fewer than 2 gaps, 0 if all are equal."""
    g = F.filter(gap, lambda x: x > 0)
    lo, hi = F.log10(F.array_min(g)), F.log10(F.array_max(g) + 1)
    at = F.transform(g, lambda x: F.least(F.lit(bins - 1), F.floor((F.log10(x) - lo) / ((hi - lo) / bins)).cast("int")))
    n = F.size(g)
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda y: y == b)) / n)
    ent = _total(F.transform(share, lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))
    return F.when(n < 2, None).when(F.array_min(g) == F.array_max(g), 0.0).otherwise(ent / math.log2(bins))


def burstiness(gap: Column) -> Column:
    """Burstiness of a finite number n of gaps: (sqrt(n + 1) r - sqrt(n - 1)) / ((sqrt(n + 1) - 2) r + sqrt(n - 1)), r = sigma / mu. Null for n < 3 or a mean of 0, -1 for equal gaps."""
    n = F.size(gap)
    mu = _total(gap) / n
    sigma = F.sqrt(_total(F.transform(gap, lambda x: (x - mu) * (x - mu))) / n)
    r = sigma / mu
    a, b = F.sqrt(n + 1), F.sqrt(F.greatest(n - 1, F.lit(0)))
    return F.when((n < 3) | (_total(gap) == 0), None).when(F.array_min(gap) == F.array_max(gap), -1.0).otherwise(F.try_divide(a * r - b, (a - 2) * r + b))


def memoryless_burstiness(sigma: Column, mu: Column) -> Column:
    """(sigma - mu) / (sigma + mu)."""
    return F.try_divide(sigma - mu, sigma + mu)


def quantization(gap: Column, targets: tuple[int, ...] = (60, 300, 900), within: int = 2) -> Column:
    """Share of gaps that lie within some seconds of a positive multiple of a target; all gaps count below the line. Null for none."""
    near = lambda x: F.exists(F.array(*map(F.lit, targets)), lambda t: (F.bround(x / t) * t > 0) & (F.abs(x - F.bround(x / t) * t) <= within))
    return F.when(F.size(gap) > 0, F.size(F.filter(gap, lambda x: (x > 0) & near(x))) / F.size(gap))


def char_entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    chars = F.split(text, "")
    n = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(text) > 0, _total(F.transform(share, lambda p: -p * F.log2(p))))


def entropy_term(share: Column) -> Column:
    """-p log2 p, 0 for p = 0; its sum over a group's shares is the entropy in bits."""
    return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the elements of the smaller array."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))).cast("double"))


def implied_votes(score: Column, ratio: Column) -> tuple[Column, Column, Column]:
    """Votes, downs and ups behind a score and its share of upvotes, where the share is over 1/2 and the score positive."""
    ok = (ratio > 0.5) & (score > 0)
    votes = F.when(ok, score / (2 * ratio - 1))
    return votes, votes * (1 - ratio), votes * ratio


def band(value: Column, moderate: float, high: float, critical: float) -> Column:
    return F.when(value >= critical, "critical").when(value >= high, "high").when(value >= moderate, "moderate").when(value.isNotNull(), "low")


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def ramp(x: Column, top: float, cap: float) -> Column:
    """``cap`` at 0 falling to 0 at ``top``, kept between."""
    return F.greatest(F.lit(0.0), F.least((top - x) / top * cap, F.lit(float(cap))))


def skewness_g1(x: str) -> Column:
    """Bias-corrected skewness; null for fewer than 3 values or no spread."""
    n = F.count(x)
    return F.when((n > 2) & (F.max(x) > F.min(x)), F.skewness(x) * F.sqrt((n * (n - 1)).cast("double")) / F.nullif(n - 2, F.lit(0)))


def pearson(a: str, b: str) -> Column:
    """Correlation of complete pairs; null without spread."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def hypergeometric(n: Column, d1: Column, d2: Column, t: Column) -> tuple[Column, Column, Column]:
    """Mean, variance and z of n shared among t when d1 and d2 are drawn at random."""
    d1, d2, t = (c.cast("double") for c in (d1, d2, t))
    mean = d1 * d2 / t
    var = F.try_divide(mean * (t - d1) * (t - d2), t * (t - 1))
    return mean, var, F.try_divide(n - mean, F.sqrt(var))
