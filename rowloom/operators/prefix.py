"""Running values and segments in row order, without sending all rows to one task.

Rows are dealt into blocks by their key, each block is a window of its own, and a small
table of one row for a block carries what came before. Blocks follow the key, so the order is that
of the table. Their number grows with the rows, and their bounds follow the counts of keys, so
that clustered keys make no large block; only rows of one key stay together.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a table, at least, and the rows of each beyond that.
BLOCKS, ROWS = 1024, 1_000_000
#: Stretches of keys with like counts; each is cut into blocks of equal width.
STRETCHES = 64


def _place(order: str, bounds: list[tuple[int, int]], each: int) -> Column:
    """The block of a key: by halving, its stretch, and in it the place by width. One text, as it is long."""

    def half(first: int, last: int) -> str:
        if first == last:
            return str(first)
        middle = (first + last) // 2
        return f"IF(`{order}` <= {bounds[middle][1]}L, {half(first, middle)}, {half(middle + 1, last)})"

    kind = "BIGINT" if max(b - a for a, b in bounds) < 2**62 else "DECIMAL(20,0)"
    stretch = half(0, len(bounds) - 1)
    starts = ",".join(f"{a}L" for a, _ in bounds)
    widths = ",".join(f"CAST({max(1, -(-(b - a + 1) // each))} AS {kind})" for a, b in bounds)
    inside = f"(CAST(`{order}` AS {kind}) - CAST(array({starts})[{stretch}] AS {kind})) DIV array({widths})[{stretch}]"
    return F.expr(f"COALESCE({each}L * {stretch} + CAST({inside} AS BIGINT), -1L)")


def with_block(df: DataFrame, order: str, known: tuple[int, int] | None = None) -> DataFrame:
    """df with _blk, rising with the whole-number column `order`; rows without a key come first.

    `known` are the least and largest of keys that are dense, and save the pass that counts them.
    """
    if known:
        bounds, rows = [known], known[1] - known[0] + 1
    else:
        shares = [i / STRETCHES for i in range(1, STRETCHES)]
        key = F.col(order).cast("long")
        rows, low, high, at = df.agg(F.count(key), F.min(key), F.max(key), F.percentile_approx(key, shares, 20 * STRETCHES)).first()
        if not rows:
            return df.withColumn("_blk", F.lit(-1).cast("long"))
        stops = sorted({x for x in at if x < high} | {high})
        bounds = list(zip([low, *[x + 1 for x in stops]], stops))
    return df.withColumn("_blk", _place(order, bounds, -(-max(BLOCKS, -(-rows // ROWS)) // len(bounds))))


def _fold(op: str) -> tuple:
    return {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}[op]


def _running(df: DataFrame, order: str, value: Column, name: str, op: str = "sum", base: Column | None = None, by: str | None = None) -> DataFrame:
    """running() on rows that have their _blk, which stays."""
    agg, join = _fold(op)
    keys = ["_blk"] if by is None else ["_blk", by]
    df = df.withColumn("_v", value)
    inner = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys).agg(agg("_v").alias("_t"))
    outer = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    # blocks with nothing before them need no row, so a group inside one block adds none
    before = sums.withColumn("_o", agg("_t").over(outer)).where("_o is not null").select(*[F.col(k).alias("_k" + k) for k in keys], "_o")
    out = df.withColumn("_w", agg("_v").over(inner))
    same = out["_blk"] == before["_k_blk"]
    if by is not None:  # it may be null: compare as equal
        same = same & out[by].eqNullSafe(before["_k" + by])
    joined = out.join(before, same, "left")
    total = F.when(F.col("_o").isNull(), F.col("_w")).otherwise(join(F.col("_w"), F.col("_o")))
    if base is not None:
        total = join(total, base)
    return joined.withColumn(name, F.when(F.col("_v").isNotNull(), total)).drop("_v", "_w", "_o", *["_k" + k for k in keys])


def running(df: DataFrame, order: str, value: Column, name: str, op: str = "sum", base: Column | None = None, by: str | None = None, known: tuple[int, int] | None = None) -> DataFrame:
    """df with `name`: value accumulated down the rows to the own one, within each `by` if given. An empty value stays empty and counts for nothing."""
    return _running(with_block(df, order, known), order, value, name, op, base, by).drop("_blk")


def _segments(cut: DataFrame, order: str, reset: str, name: str) -> DataFrame:
    w = Window.partitionBy("_blk").orderBy(order)
    tail = cut.groupBy("_blk").agg(F.max_by(F.struct(reset), F.struct(F.col(order).isNotNull(), order)).alias("_last"))
    carried = tail.withColumn("_prev", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_blk"))).select(F.col("_blk").alias("_b2"), "_prev")
    flagged = cut.withColumn("_in", F.lag(F.struct(reset)).over(w)).join(carried, F.col("_blk") == F.col("_b2"), "left")
    before = F.coalesce("_in", "_prev")
    new = F.when(before.isNull() | ~before[reset].eqNullSafe(F.col(reset)), 1).otherwise(0).cast("long")
    return _running(flagged, order, new, name).drop("_in", "_prev", "_b2")


def segments(df: DataFrame, order: str, reset: str, name: str, known: tuple[int, int] | None = None) -> DataFrame:
    """df with `name`: the number of the run of equal neighbours in `reset` that a row is in, from 1."""
    return _segments(with_block(df, order, known), order, reset, name).drop("_blk")


def running_reset(df: DataFrame, order: str, value: Column, reset: str, name: str, op: str = "sum", base: Column | None = None, known: tuple[int, int] | None = None) -> DataFrame:
    """Like running(), anew whenever `reset` differs from the row before: segments, not groups."""
    cut = _segments(with_block(df, order, known), order, reset, "_seg")
    return _running(cut, order, value, name, op, base, by="_seg").drop("_seg", "_blk")


def row_number(df: DataFrame, order: str, name: str) -> DataFrame:
    """Ranks from 1 down the whole table."""
    return running(df, order, F.lit(1).cast("long"), name)
