"""Exact shares: whole parts and largest remainders, on the driver, and their lookup as columns."""
from __future__ import annotations

import hashlib
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F


def counts(n: int, weights: list[float], seed: str = "", stream: str = "") -> list[int]:
    """n parts by weight; ties of the remainders are broken by a keyed draw."""
    total = float(sum(weights))
    if n < 0 or total <= 0 or any(w < 0 for w in weights):
        raise ValueError("shares need a count of 0 or more and weights that add up to more than 0")
    exact = [n * w / total for w in weights]
    out = [int(x + 1e-9) for x in exact]
    key = lambda i: (-round(exact[i] - out[i], 9), hashlib.sha256(f"{seed}|{stream}|{i}".encode()).digest())
    for i in sorted(range(len(weights)), key=key)[: n - sum(out)]:
        out[i] += 1
    return out


def shares(mask: str | None, k: int) -> list[float]:
    """A percent mask for k values: blanks split what is left, missing entries too; the total must be 100."""
    if not mask:
        return [100.0 / k] * k
    given = [x.strip() for x in mask.split(",")]
    if len(given) > k:
        raise ValueError(f"{len(given)} shares for {k} values")
    given += [""] * (k - len(given))
    known = sum(float(x) for x in given if x)
    blanks = sum(not x for x in given)
    if (blanks == 0 and abs(known - 100) > 1e-4) or known > 100 + 1e-4:
        raise ValueError(f"shares add up to {known:g}, not 100")
    return [float(x) if x else (100 - known) / blanks for x in given]


def pick(place: Column, parts: list[int], values: list) -> Column:
    """The value whose run of slots holds `place`."""
    ends = list(accumulate(parts))
    if len(values) <= 40:
        out = None
        for end, size, v in zip(ends, parts, values, strict=True):
            if size:
                v = v if isinstance(v, Column) else F.lit(v)
                out = F.when(place < end, v) if out is None else out.when(place < end, v)
        return F.lit(None) if out is None else out
    at = which(place, parts)
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def which(place: Column, parts: list[int]) -> Column:
    """The number of the run that holds `place`, by bisection over the bounds."""
    ends = list(accumulate(parts))

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(place < ends[mid], half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(ends) - 1)
