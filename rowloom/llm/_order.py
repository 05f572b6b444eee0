"""Exact, repeatable bounds that cut a table by a key into runs of like weight."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a histogram; as many rows reach the driver for each pass.
CELLS = 4096


def upper_bounds(df: DataFrame, key: str, weight: Column, runs: int) -> list[int]:
    """Rising upper bounds (inclusive) of at most about `runs` runs over the long column `key`.

    Cells of equal width are counted; a cell heavier than half a run is cut into finer
    cells until it is light or a single key. Only counts reach the driver, CELLS for each
    pass, and the same rows give the same bounds.
    """
    df = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), weight.cast("double").alias("w"))
    low, high, total = df.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if low is None:
        return []
    goal = max(1.0, (total or 0.0) / max(1, runs))
    cells, todo = [], [(low, high)]
    while todo:
        share = max(2, CELLS // len(todo))
        cond, again = None, []
        for i, (a, b) in enumerate(todo):
            width = max(1, -(-(b - a + 1) // share))
            inside = F.col("k").between(a, b)
            cell = F.struct(F.lit(i).alias("i"), F.floor((F.col("k") - a) / F.lit(width)).cast("long").alias("c"))
            cond = F.when(inside, cell) if cond is None else cond.when(inside, cell)
        counted = df.select(cond.alias("x"), "w").where("x is not null").groupBy("x").agg(F.sum("w").alias("w")).collect()
        for r in counted:
            a, b = todo[r.x.i]
            width = max(1, -(-(b - a + 1) // share))
            start = a + r.x.c * width
            stop = min(b, start + width - 1)
            if r.w > goal / 2 and stop > start:
                again.append((start, stop, r.w))
            else:
                cells.append((start, stop, r.w))
        # the heaviest go on; cells beyond what a pass can hold stay as they are
        again.sort(key=lambda x: -x[2])
        cells += again[256:]
        todo = [x[:2] for x in again[:256]]
    out, filled = [], 0.0
    for _, stop, w in sorted(cells):
        filled += w
        if filled >= goal:
            out.append(stop)
            filled = 0.0
    if not out or out[-1] < high:
        out.append(high)
    return out


def run_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(bounds, keys, "left"), max(0, len(bounds) - 1))
