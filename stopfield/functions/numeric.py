"""Numeric expressions: safe ratios, bins, links, interpolation on knots and the t distribution."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_number(name: str, present: Sequence[str]) -> Column:
    """Lenient double: text that is no number, and a column that is absent, become null."""
    if name not in present:
        return F.lit(None).cast("double")
    return F.col(name).try_cast("double")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """``scale * top / bottom`` where the bottom is positive, else null."""
    return F.when(bottom > 0, F.lit(scale) * top / bottom)


def clip(c: Column, low: float, high: float) -> Column:
    """Clamp, null staying null (least / greatest would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def snap(c: Column, width: float) -> Column:
    """Nearest multiple of ``width``, ties to even, clipped to 0-100."""
    return clip(F.round(F.rint(c / width) * width, 10), 0.0, 100.0)


def ceil_tens(c: Column) -> Column:
    return F.ceil(c / 10 - F.lit(1e-9)) * 10


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def softplus(x: Column) -> Column:
    """ln(1 + e^x), written so that large inputs do not overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_logistic(x: Column) -> Column:
    """ln of the logistic function."""
    return -softplus(-x)


def bin_of(c: Column, edges: Sequence[float]) -> Column:
    """How many of the ascending inner edges lie below the value; an edge belongs to the bin it closes."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(c > F.lit(float(e)), 1).otherwise(0)
    return F.when(c.isNotNull(), out)


def significant(c: Column, digits: int) -> Column:
    """Round to a number of significant digits; zero stays zero."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c * scale) / scale)


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float], log_axis: bool = False) -> Column:
    """Clamped piecewise linear curve through the knots, on a linear or a logarithmic x axis."""
    def tick(v):
        return math.log(v) if log_axis else float(v)

    axis = F.ln(x) if log_axis else x
    out = F.when(axis <= F.lit(tick(xs[0])), F.lit(float(ys[0])))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        a, b = tick(x0), tick(x1)
        out = out.when(axis <= F.lit(b), F.lit(float(y0)) + (axis - F.lit(a)) * F.lit((y1 - y0) / (b - a)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(ys[-1]))))


# Coefficients of the Stirling series of ln gamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def ln_gamma(x: Column) -> Column:
    """ln gamma for x > 0: the argument is lifted by eight, then the Stirling series is exact to about 1e-12."""
    z = x + 8
    series = F.lit(0.0)
    for k, coefficient in enumerate(STIRLING):
        series = series + F.lit(coefficient) / F.pow(z, F.lit(2 * k + 1))
    lifted = (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series
    steps = F.ln(x)
    for k in range(1, 8):
        steps = steps + F.ln(x + k)
    return lifted - steps


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever the number of its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fields(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def beta_fraction(a: Column, b: Column, x: Column, rounds: int = 200) -> Column:
    """Continued fraction of the incomplete beta function by the modified Lentz recurrence, as one fold over a fixed sequence."""
    tiny = F.lit(1e-300)

    def guard(v):
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def half(acc, term):
        ready = _fields(c=guard(1 + term / acc["c"]), d=1 / guard(1 + term * acc["d"]), f=acc["f"])
        return let(ready, lambda h: _fields(c=h["c"], d=h["d"], f=h["f"] * h["c"] * h["d"]))

    def step(acc, i):
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(half(acc, even), lambda h: half(h, odd))

    start = let(1 / guard(1 - (a + b) * x / (a + 1)), lambda d: _fields(c=F.lit(1.0), d=d, f=d))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda acc: acc["f"])


def _beta_tail(t: Column, dof: Column) -> Column:
    a, x = dof / 2, dof / (dof + t * t)
    mirrored = x >= (a + 1) / (a + 2.5)
    half = F.lit(0.5)
    chosen = _fields(
        swap=mirrored, a=F.when(mirrored, half).otherwise(a), b=F.when(mirrored, a).otherwise(half), x=F.when(mirrored, 1 - x).otherwise(x)
    )

    def value(s):
        a_, b_, x_ = s["a"], s["b"], s["x"]
        front = F.exp(ln_gamma(a_ + b_) - ln_gamma(a_) - ln_gamma(b_) + a_ * F.ln(x_) + b_ * F.ln(1 - x_))
        part = front * beta_fraction(a_, b_, x_) / a_
        return F.when(s["swap"], 1 - part).otherwise(part)

    return let(chosen, value)


# Polynomial of the complementary error function (fractional error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_two_sided(z: Column) -> Column:
    u = F.abs(z) / math.sqrt(2)

    def value(k):
        poly = F.lit(ERFC[-1])
        for coefficient in reversed(ERFC[:-1]):
            poly = poly * k + F.lit(coefficient)
        return k * F.exp(-u * u + poly)

    return let(1 / (1 + u / 2), value)


LARGE_DOF = 5000


def t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t, for the few rows of a result table. Pass plain columns: they are used many times.

    Beyond ``LARGE_DOF`` degrees of freedom t is first carried to its normal deviate.
    """
    deviate = F.sqrt((dof - 0.5) * F.log1p(t * t / dof)) * (1 - 0.75 / (dof * dof))
    return (
        F.when(t.isNull() | dof.isNull(), F.lit(None).cast("double"))
        .when(t == 0, F.lit(1.0))
        .when(dof > LARGE_DOF, normal_two_sided(deviate))
        .otherwise(_beta_tail(t, dof))
    )
