"""Keyed draws: every value is a function of seed, stream and row, whatever the partitions."""
from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Permutations up to this size are an array in the plan; larger ones are computed.
SMALL = 1024
ROUNDS, WALKS = 4, 10


def hashed(seed: str, stream: str, row: Column, k: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(stream), row.cast("long"), F.lit(k))


def uniform(seed: str, stream: str, row: Column, k: int = 0) -> Column:
    """In (0, 1), never its ends."""
    return (F.shiftrightunsigned(hashed(seed, stream, row, k), 11).cast("double") + 0.5) / F.lit(float(2**53))


def between(seed: str, stream: str, row: Column, low: int, high: int, k: int = 0) -> Column:
    """A whole number from low to high, both included."""
    return F.lit(low) + F.least(F.floor(uniform(seed, stream, row, k) * (high - low + 1)).cast("long"), F.lit(high - low))


def order(seed: str, stream: str, n: int) -> list[int]:
    """The permutation that slot() follows for small n, on the driver."""
    return sorted(range(n), key=lambda i: hashlib.sha256(f"{seed}|{stream}|{i}".encode()).digest())


def _sides(n: int) -> tuple[int, int]:
    a = math.isqrt(n - 1) + 1
    return a, -(-n // a)


def _shuffle(x: Column, seed: str, stream: str, a: int, b: int) -> Column:
    """A bijection of 0 .. a*b-1: each round adds to one coordinate a hash of the other."""
    left, right = F.pmod(x, F.lit(a)), F.floor(x / F.lit(a)).cast("long")
    for j in range(ROUNDS):
        if j % 2 == 0:
            left = F.pmod(left + F.pmod(hashed(seed, stream, right, j), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(hashed(seed, stream, left, j), F.lit(b)), F.lit(b))
    return right * a + left


def slot(seed: str, stream: str, n: int, row: Column) -> Column:
    """Where row (0 .. n-1) stands in a keyed permutation of 0 .. n-1.

    Large n: a Feistel walk over the least a*b >= n with a, b near sqrt(n); the share of
    rows that need another step is under 2/sqrt(n), so ten steps fail for no row in practice, and loudly if ever.
    """
    row = row.cast("long")
    if n <= 1:
        return row * 0
    if n <= SMALL:
        return F.element_at(F.array(*[F.lit(i).cast("long") for i in order(seed, stream, n)]), (row + 1).cast("int"))
    a, b = _sides(n)
    once = _shuffle(row, seed, stream, a, b)
    if a * b == n:
        return once
    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once, lambda x, _: F.when(x < n, x).otherwise(_shuffle(x, seed, stream, a, b)))
    return F.when(once < n, once).when(again < n, again).otherwise(F.raise_error(F.lit("the keyed permutation did not settle")).cast("long"))
