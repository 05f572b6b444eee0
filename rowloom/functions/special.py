"""Special functions and inverse distribution functions, for Arrow batches."""
from __future__ import annotations

import math


def digamma(x: float) -> float:
    if x <= 0 and x == math.floor(x):
        return math.nan
    if x < 0:
        return digamma(1 - x) - math.pi / math.tan(math.pi * x)
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def zeta(s: float) -> float:
    """By Euler and Maclaurin for s > 1, by reflection below."""
    if s == 1:
        return math.inf
    if s < 0.5:
        return 2**s * math.pi ** (s - 1) * math.sin(math.pi * s / 2) * math.gamma(1 - s) * zeta(1 - s)
    n = 20
    out = sum(k**-s for k in range(1, n)) + n ** (1 - s) / (s - 1) + n**-s / 2
    term = s * n ** (-s - 1)
    for k, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66), 1):
        out += b / math.factorial(2 * k) * term
        term *= (s + 2 * k - 1) * (s + 2 * k) / (n * n)
    return out


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = out = 1 / a
        k = a
        while abs(term) > abs(out) * 1e-16:
            k += 1
            term *= x / k
            out += term
        return out * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _invert(f, u: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if f(mid) < u else (lo, mid)
    return (lo + hi) / 2


def gamma_inverse(u: float, shape: float, scale: float) -> float:
    hi = max(1.0, 2 * shape)
    while gamma_p(shape, hi) < u:
        hi *= 2
    return scale * _invert(lambda x: gamma_p(shape, x), u, 0.0, hi)


def beta_inverse(u: float, a: float, b: float) -> float:
    return _invert(lambda x: beta_i(a, b, x), u, 0.0, 1.0)


FUNCTIONS = {
    "erf": math.erf, "erfc": math.erfc, "gamma": math.gamma, "lgamma": math.lgamma, "digamma": digamma, "zeta": zeta,
    "beta": lambda a, b: math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)),
}
