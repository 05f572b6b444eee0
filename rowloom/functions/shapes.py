"""Statistical shapes from uniforms: distributions, quantiles, series and drawn curves."""
from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special


def half_away(c: Column, decimals: int) -> Column:
    return F.round(c, decimals)


def normal(u1: Column, u2: Column, mean=0.0, sd=1.0) -> Column:
    return _c(mean) + _c(sd) * F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)


def lognormal(u1: Column, u2: Column, meanlog=0.0, sdlog=1.0) -> Column:
    return F.exp(normal(u1, u2, meanlog, sdlog))


def exponential(u: Column, rate=1.0) -> Column:
    return -F.ln(1 - u) / _c(rate)


def pareto(u: Column, alpha=1.0, xmin=1.0) -> Column:
    return _c(xmin) / F.pow(1 - u, 1 / _c(alpha))


def weibull(u: Column, shape=1.0, scale=1.0) -> Column:
    return _c(scale) * F.pow(-F.ln(1 - u), 1 / _c(shape))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _from_table(u: Column, ends: list[float], first: int) -> Column:
    """The place of u among rising bounds, by bisection in an Arrow batch."""

    @F.pandas_udf("long")
    def look(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else min(bisect.bisect_left(ends, v), len(ends) - 1) + first)

    return look(u)


def poisson(u: Column, rate: float | Column) -> Column:
    """Inverse of the distribution function; rate up to 700."""
    if isinstance(rate, Column):
        @F.pandas_udf("long")
        def one(us: pd.Series, rs: pd.Series) -> pd.Series:
            return pd.Series([None if pd.isna(r) else _poisson_at(v, r) for v, r in zip(us, rs, strict=True)], dtype="Int64")

        return one(u, rate)
    if not 0 < rate <= 700:
        raise ValueError("lambda must be over 0 and at most 700")
    ends, p, total, k = [], math.exp(-rate), 0.0, 0
    while total < 1 - 1e-15 and k < 10 * rate + 100:
        total += p
        ends.append(total)
        k += 1
        p *= rate / k
    return _from_table(u, ends, 0)


def _poisson_at(u: float, rate: float) -> int:
    if not 0 < rate <= 700:
        raise ValueError("lambda must be over 0 and at most 700")
    k, p = 0, math.exp(-rate)
    total = p
    while total < u and k < 10 * rate + 100:
        k += 1
        p *= rate / k
        total += p
    return k


def zipf(u: Column, n: int, s: float) -> Column:
    if not 1 <= n <= 10_000_000:
        raise ValueError("n must be from 1 to 10,000,000")
    total, ends = 0.0, []
    for k in range(1, n + 1):
        total += k**-s
        ends.append(total)
    return _from_table(u * total, ends, 1)


def gamma(u: Column, shape: float, scale: float = 1.0) -> Column:
    return _inverse(u, lambda v: special.gamma_inverse(v, shape, scale))


def beta(u: Column, alpha: float, b: float) -> Column:
    return _inverse(u, lambda v: special.beta_inverse(v, alpha, b))


def _inverse(u: Column, f) -> Column:
    @F.pandas_udf("double")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(f)

    return apply(u)


def clipped(c: Column, low: float | None, high: float | None) -> Column:
    c = F.greatest(c, F.lit(float(low))) if low is not None else c
    return F.least(c, F.lit(float(high))) if high is not None else c


def quantile(u: Column, values: list[float]) -> Column:
    """The inverse distribution of a sample: positions u * n - 0.5, in between linearly, the ends level."""
    v = sorted(float(x) for x in values)
    n = len(v)
    p = F.least(F.greatest(u * n - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
    i = F.floor(p).cast("int")
    a = F.array(*[F.lit(x) for x in v])
    lo, hi = F.element_at(a, i + 1), F.element_at(a, F.least(i + 2, F.lit(n)))
    return lo + (p - i) * (hi - lo)


def exact_u(slot: Column, n: int) -> Column:
    """For a sample without noise: the middle of each of n equal shares."""
    return (slot + 0.5) / float(max(1, n))


def timeseries(i: Column, base=0.0, trend=0.0, period=None, amplitude=0.0, peak_at=None, noise=0.0, z: Column | None = None) -> Column:
    out = F.lit(float(base)) + float(trend) * i
    if period:
        peak = period / 4 if peak_at is None else peak_at
        out = out + float(amplitude) * F.cos(2 * math.pi * (i - float(peak)) / float(period))
    return out + float(noise) * z if noise and z is not None else out


def curve(points: list[tuple[float, float]], t: Column, interp: str = "linear") -> Column:
    """The height at t of a curve through points: linear, step, or smooth (monotone cubic)."""
    pts = sorted({float(x): float(y) for x, y in points}.items())
    if len(pts) == 1:
        return F.lit(pts[0][1])
    x, y = [p[0] for p in pts], [p[1] for p in pts]
    h = [b - a for a, b in zip(x, x[1:])]
    d = [(b - a) / w for a, b, w in zip(y, y[1:], h)]
    m = [d[0], *[0.0 if a * b <= 0 else (wa + wb) / (wa / a + wb / b) for a, b, wa, wb in zip(d, d[1:], [2 * q + p for p, q in zip(h, h[1:])], [q + 2 * p for p, q in zip(h, h[1:])])], d[-1]]

    def piece(i: int) -> Column:
        s = (t - x[i]) / h[i]
        if interp == "step":
            return F.lit(y[i])
        if interp == "linear":
            return y[i] + (y[i + 1] - y[i]) * s
        return (2 * s * s * s - 3 * s * s + 1) * y[i] + (s * s * s - 2 * s * s + s) * (h[i] * m[i]) + (-2 * s * s * s + 3 * s * s) * y[i + 1] + (s * s * s - s * s) * (h[i] * m[i + 1])

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return piece(lo)
        mid = (lo + hi) // 2
        return F.when(t < x[mid + 1], half(lo, mid)).otherwise(half(mid + 1, hi))

    return F.when(t <= x[0], F.lit(y[0])).when(t >= x[-1], F.lit(y[-1])).otherwise(half(0, len(h) - 1))


def scaled(points: list[tuple[float, float]], low: float, high: float) -> list[tuple[float, float]]:
    """x to 0..1 and y to low..high."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    w, h = max(xs) - min(xs) or 1.0, max(ys) - min(ys)
    return [((x - min(xs)) / w, low + (high - low) * ((y - min(ys)) / h if h else 0.5)) for x, y in points]


def density(u: Column, points: list[tuple[float, float]], low: float, high: float, grid: int = 512) -> Column:
    """A draw whose unnormalised density is the curve: the inverse of its distribution on a grid."""
    pts = sorted(points)
    xs, ys = [p[0] for p in pts], [max(0.0, p[1]) for p in pts]
    at = [xs[0] + (xs[-1] - xs[0]) * k / (grid - 1) for k in range(grid)]
    height = []
    for q in at:
        i = min(max(bisect.bisect_right(xs, q) - 1, 0), len(xs) - 2)
        height.append(ys[i] + (ys[i + 1] - ys[i]) * (q - xs[i]) / (xs[i + 1] - xs[i]))
    sums = [0.0]
    for a, b in zip(height, height[1:]):
        sums.append(sums[-1] + (a + b) / 2)
    if sums[-1] <= 0:
        raise ValueError("the density is zero everywhere")
    steps = [(s / sums[-1], low + (high - low) * k / (grid - 1)) for k, s in enumerate(sums)]

    @F.pandas_udf("double")
    def invert(s: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(np.interp(s, [a for a, _ in steps], [b for _, b in steps]))

    return invert(u)
