"""Column expressions shared by the operators. NULL is the only missing value."""

import math

import numpy as np

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c) -> Column:
    """The value when it is a real number, else NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def clip(x, lo, hi) -> Column:
    """greatest/least skip NULLs, so a NULL value is guarded explicitly."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(col(lo), F.least(col(hi), x)))


def positive_part(x) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def guarded_reciprocal(x) -> Column:
    x = col(x)
    return F.when(x > 0, F.lit(1.0) / x)


def ratio(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def change(now, before) -> Column:
    return F.try_divide(col(now), col(before)) - 1


def trend_label(x, up=0.01, down=-0.01) -> Column:
    x = col(x)
    return (F.when(x.isNull(), F.lit("n/a")).when(x > up, F.lit("strengthening"))
            .when(x < down, F.lit("weakening")).otherwise(F.lit("stable")))


def theme_slug(theme) -> Column:
    return F.concat(F.lit("score__"), F.lower(F.replace(col(theme), F.lit(" "), F.lit("_"))))


def period_start(date, freq) -> Column:
    """First day of the quarter ('Q') or month ('M') holding the date."""
    unit = {"Q": "quarter", "M": "month"}[freq]
    return F.date_trunc(unit, col(date)).cast("date")


def quarter_end(date) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", col(date)).cast("date"), 2))


def pearson(cov, sd_x, sd_y) -> Column:
    """The built-in corr raises on a constant side in ANSI mode; this returns NULL."""
    return F.try_divide(cov, sd_x * sd_y)


def _gamma_ratio(a) -> Column:
    """gamma(a + 1/2) / gamma(a): the asymptotic series 32 above a, brought down by the recurrence."""
    n = a + 32
    series = 1 - 1 / (8 * n) + 1 / (128 * n * n) + 5 / (1024 * n ** 3) - 21 / (32768 * n ** 4) - 399 / (262144 * n ** 5)
    down = F.lit(1.0)
    for k in range(32):
        down = down * ((a + k) / (a + k + 0.5))
    return F.sqrt(n) * series * down


def _quadrature(nodes, weights, value) -> Column:
    rule = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(nodes, weights)])
    return F.aggregate(rule, F.lit(0.0), lambda acc, q: acc + q["w"] * value(q["x"]))


def student_t_p(t, dof) -> Column:
    """Two-sided Student-t p-value for whole degrees of freedom, by a fixed number of quadrature nodes: the middle of the
    density by Gauss-Legendre below t = 2, and from there its tail by Gauss-Laguerre, whose relative error stays small
    however small the tail is."""
    t, dof = F.abs(col(t)), col(dof).cast("long")
    nu = dof.cast("double")
    a = nu / 2
    ratio = _gamma_ratio(a)
    x, w = np.polynomial.legendre.leggauss(32)
    middle = t * _quadrature((x + 1) / 2, w / 2, lambda u: F.exp(-(nu + 1) / 2 * F.log1p(u * u * t * t / nu)))
    below = 1 - 2 * ratio / F.sqrt(nu * math.pi) * middle
    x, w = np.polynomial.laguerre.laggauss(64)
    keep = w > 1e-40
    log_x = -F.log1p(t * t / nu)
    tail = _quadrature(x[keep], w[keep], lambda v: 1 / F.sqrt(-F.expm1(log_x - v / a)))
    above = F.exp(a * log_x) * ratio / (a * math.sqrt(math.pi)) * tail
    return F.when(t.isNotNull() & (dof >= 1), F.when(t < 2, F.greatest(below, F.lit(0.0))).otherwise(above))
