"""Column expressions: normal distribution, counter-based uniforms, missing values."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649

# Abramowitz and Stegun 7.1.26, absolute error under 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2.0)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(x) * erf)


def normal_cdf_sql(x: str) -> str:
    z = f"(abs({x}) / {math.sqrt(2.0)!r}::DOUBLE)"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P}::DOUBLE * {z}))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})::DOUBLE) * {t})"
    return f"(0.5::DOUBLE * (1.0::DOUBLE + sign({x}) * (1.0::DOUBLE - {poly} * exp(-{z} * {z}))))"


def digest(*key: Column | str) -> Column:
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key]
    return F.md5(F.concat_ws("|", *parts))


def uniform_at(hexes: Column, at: int = 1) -> Column:
    """A uniform in (0, 1) from eight hexadecimal digits of a digest."""
    return (F.conv(F.substring(hexes, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def uniform(*key: Column | str) -> Column:
    """A uniform in (0, 1) that depends on the key alone, not on partitions or row order."""
    return uniform_at(digest(*key))


def uniform_sql(*key: str, at: int = 1) -> str:
    text = " || '|' || ".join(f"({k})::VARCHAR" for k in key)
    return f"((('0x' || substr(md5({text}), {at}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def trailing(x: str, by, back: int, rows: bool = False) -> tuple[Column, Column, Column]:
    """Count, mean and sample deviation of x over the last `back` units of the ordering, this row's included.

    Differences of two growing sums: a frame that only grows is updated once a row, while a sliding frame
    is summed anew for each. by is a window ordered by a number; rows counts rows instead of its units.
    """
    from pyspark.sql import Window

    frame = by.rowsBetween if rows else by.rangeBetween
    upto, before = frame(Window.unboundedPreceding, 0), frame(Window.unboundedPreceding, -back)
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0)) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    n = F.count(x).over(upto) - F.count(x).over(before)
    s1, s2 = total(F.col(x)), total(F.col(x) * F.col(x))
    var = F.greatest(s2 - s1 * s1 / F.nullif(n, F.lit(0)), F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    return n, s1 / F.nullif(n, F.lit(0)), F.sqrt(var)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def mean_rank(score: Column | str, *keys: str) -> Column:
    """Rank within the keys where ties share the middle of their ranks: both windows use one sort."""
    from pyspark.sql import Window

    s = F.col(score) if isinstance(score, str) else score
    ties = F.count("*").over(Window.partitionBy(*keys, s))
    return F.rank().over(Window.partitionBy(*keys).orderBy(s)) + (ties - 1) / F.lit(2.0)


def expected_max_sharpe(variance: float, n_trials: int) -> float:
    """Expected largest Sharpe ratio of n_trials strategies of noise with this variance of their ratios."""
    if n_trials <= 1:
        return 0.0
    return math.sqrt(variance) * max_of_normals(n_trials)


def max_of_normals(n_trials: int) -> float:
    if n_trials <= 1:
        return 0.0
    ppf = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * ppf(1 - 1 / n_trials) + EULER_GAMMA * ppf(1 - 1 / (n_trials * math.e))


def probabilistic_sharpe(sr: Column, at: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """P(true ratio > at) from per-period ratio, sample length, skewness and raw kurtosis."""
    spread = F.sqrt(1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr)
    return normal_cdf((sr - at) * F.sqrt(n - 1.0) / spread)


def sharpe(mean: Column, sd: Column, periods: int = 52) -> Column:
    """Annualised ratio; null where the deviation is zero or unknown."""
    return F.when(sd > 0, mean / sd * math.sqrt(periods))
