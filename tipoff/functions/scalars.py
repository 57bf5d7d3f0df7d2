"""Scalar expressions of the box-score and probability formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz & Stegun 26.2.17: scale and polynomial coefficients (fixed values).
PHI_SCALE = 0.2316419
PHI_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def possessions(fga, orb, to, fta) -> Column:
    """Estimated possessions of one side."""
    return col(fga) - col(orb) + col(to) + F.lit(0.475) * col(fta)


def efficiency(points, poss) -> Column:
    """Points per 100 possessions; null where there were none."""
    return F.when(col(poss) > 0, F.lit(100.0) * col(points) / col(poss))


def ratio(top, bottom) -> Column:
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def seed_baseline(seed_a, seed_b, slope: float = 0.15) -> Column:
    """Win probability of a from the seeds alone."""
    return logistic(F.lit(slope) * (col(seed_b) - col(seed_a)))


def normal_cdf(x) -> Column:
    """Standard normal distribution, absolute error under 7.5e-8."""
    x = col(x)
    a = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(PHI_SCALE) * a)
    poly = F.lit(0.0)
    for c in reversed(PHI_TERMS):
        poly = (poly + F.lit(c)) * t
    tail = F.exp(-a * a / 2) / F.lit(2.5066282746310002) * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def line_to_prob(spread, sigma: float = 11.0) -> Column:
    """Win probability of a side favoured by `spread` points."""
    return normal_cdf(col(spread) / F.lit(sigma))


def blend(p, q, weight) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return (F.lit(1.0) - w) * col(p) + w * col(q)


def shrink(p, factor) -> Column:
    """Towards one half."""
    return blend(p, F.lit(0.5), factor)


def clip(x, low: float, high: float) -> Column:
    return F.greatest(F.least(col(x), F.lit(high)), F.lit(low))


def seed_number(seed) -> Column:
    """Digits of a seed such as W01 or X16a; 16 where there are none."""
    digits = F.nullif(F.regexp_extract(col(seed), r"(\d+)", 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(16))


def clean_name(name) -> Column:
    """Lower case, underscores to blanks, quotes and outer blanks gone."""
    return F.trim(F.replace(F.lower(F.btrim(F.trim(col(name)), F.lit('"'))), F.lit("_"), F.lit(" ")))


def numeric(x) -> Column:
    """A number, or null where the text is none."""
    return F.trim(col(x)).try_cast("double")
