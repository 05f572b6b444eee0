"""Running values and segments against a plain loop, and the evenness of blocks."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import prefix


def _rows(kind: str, n: int = 3000) -> list:
    r = random.Random(kind)
    keys = {
        "dense": range(n), "negative": range(-n, 0),
        "clustered": [*range(n - 3), 10**15, 2 * 10**15, 2**62],
        "whole range": sorted({-(2**63) + 1, 2**63 - 1, *(r.randrange(-(2**63) + 2, 2**63 - 2) for _ in range(n))}),
        "none": [],
    }[kind]
    return [(k, r.choice([None, *range(-9, 10)]), r.choice("ab")) for k in keys]


@pytest.mark.parametrize("kind,rows", [("dense", prefix.ROWS), ("negative", 1), ("clustered", 1), ("whole range", prefix.ROWS), ("none", 1)])
def test_running_values(spark, monkeypatch, kind, rows):
    monkeypatch.setattr(prefix, "ROWS", rows)
    data = _rows(kind)
    df = spark.createDataFrame(random.Random(1).sample(data, len(data)), "k long, v long, g string")
    known = (0, len(data) - 1) if kind == "dense" else None
    total = prefix.running(df, "k", F.col("v"), "t", base=F.lit(5), known=known)
    low = prefix.running(total, "k", F.col("v"), "low", "min", by="g", known=known)
    got = prefix.running_reset(prefix.segments(low, "k", "g", "s", known), "k", F.col("v"), "g", "r", "max", known=known)
    assert sorted(set(got.columns)) == sorted(["k", "v", "g", "t", "low", "s", "r"])
    want, t, lows = [], 5, {}
    for s, (_, run) in enumerate(itertools.groupby(data, lambda x: x[2]), 1):
        most = None
        for k, v, g in run:
            if v is not None:
                t, lows[g], most = t + v, min(lows.get(g, v), v), v if most is None else max(most, v)
            want.append((k, v, g, *((None, None) if v is None else (t, lows[g])), s, None if v is None else most))
    assert sorted(tuple(x) for x in got.select("k", "v", "g", "t", "low", "s", "r").collect()) == want


def test_rows_without_a_key_come_first(spark):
    df = spark.createDataFrame([(None, 1, "a"), (3, 2, "a"), (9, 4, "b")], "k long, v long, g string")
    got = prefix.running_reset(prefix.running(df, "k", F.col("v"), "t"), "k", F.col("v"), "g", "r").collect()
    assert {(x.k, x.t, x.r) for x in got} == {(None, 1, 1), (3, 3, 3), (9, 7, 4)}


def test_blocks_follow_the_counts_of_keys(spark, monkeypatch):
    """Half of the keys lie within a billionth of their range: of equal width, one block would hold them all."""
    monkeypatch.setattr(prefix, "ROWS", 100)
    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") < n / 2, F.col("id")).otherwise(F.col("id") * 10**9).alias("k"))
    sizes = sorted(x["count"] for x in prefix.with_block(df, "k").groupBy("_blk").count().collect())
    assert len(sizes) > 1900 and sizes[-1] < 1.2 * n / prefix.STRETCHES  # only the stretch with the jump is uneven
    assert sizes[-2] < 200
