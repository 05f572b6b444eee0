"""Relations between columns and small tables: lookups, pools, linked rows, sub-populations, lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import apportion, rng

#: Members of a pool, at most; so many are broadcast at any rate.
POOL_LIMIT = 1_000_000


def match_key(c: Column) -> Column:
    """Equal for values that compare loosely equal: whole numbers by value, other text by itself."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?\d+$"), F.coalesce(t.try_cast("decimal(38,0)").cast("string"), t)).otherwise(c.cast("string"))


def switch(on: Column, table: dict[str, Column | str], default: Column | None = None) -> Column:
    """The branch whose key (several joined by |) is the subject's; without one, the default or an empty cell."""
    out = None
    for keys, value in table.items():
        value = value if isinstance(value, Column) else F.lit(value)
        hit = match_key(on).isin(*[str(int(k)) if k.strip().lstrip("+-").isdigit() else k for k in (x.strip() for x in keys.split("|"))])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    rest = F.lit("") if default is None else default
    return rest if out is None else out.otherwise(rest)


def switch_table(df: DataFrame, on: str, table: DataFrame, key: str, value: str, name: str, default: Column | None = None) -> DataFrame:
    """switch() by a table of any size."""
    t = table.select(match_key(F.col(key)).alias("_k"), F.col(value).alias("_v"))
    out = df.withColumn("_m", match_key(F.col(on))).join(t, F.col("_m") == F.col("_k"), "left")
    return out.withColumn(name, F.coalesce("_v", F.lit("") if default is None else default)).drop("_m", "_k", "_v")


def first_match(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first true condition, else nothing."""
    out = None
    for cond, value in branches:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def parent(cond: Column, value: Column) -> Column:
    """The value where the condition holds; elsewhere the column does not exist (NULL)."""
    return F.when(F.coalesce(cond, F.lit(False)), value)


def quota(df: DataFrame, order: str, cond: Column, values: list, percent: str | None, name: str, seed: str, stream: str) -> DataFrame:
    """An exact split of the sub-population that meets the condition; NULL elsewhere. The rank in the sub-population is a two-level prefix."""
    from .prefix import running

    n = df.where(cond).count()
    parts = apportion.counts(n, apportion.shares(percent, len(values)), seed, stream)
    ranked = running(df, order, F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("long"), "_rank")
    place = rng.slot(seed, stream, n, F.col("_rank") - 1)
    return ranked.withColumn(name, F.when(cond, apportion.pick(place, parts, values))).drop("_rank")


def _small(pool: DataFrame, limit: int) -> int:
    n = pool.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"a pool has at most {limit} members")
    if n == 0:
        raise ValueError("a pool has no members")
    return n


def pool_pick(df: DataFrame, pool: DataFrame, order_by: str, u: Column, prefix: str, limit: int = POOL_LIMIT) -> DataFrame:
    """Each row with one whole member of the pool, picked evenly by u in (0, 1)."""
    n = _small(pool, limit)
    members = pool.withColumn("_i", F.row_number().over(Window.orderBy(order_by)) - 1)
    members = members.select("_i", *[F.col(c).alias(f"{prefix}{c}") for c in pool.columns])
    out = df.withColumn("_n", F.least(F.floor(u * n), F.lit(n - 1)).cast("int"))
    return out.join(F.broadcast(members), out["_n"] == members["_i"]).drop("_n", "_i")


def pool_pick_equal(df: DataFrame, pool: DataFrame, order_by: str, mine: str, theirs: str, u: Column, prefix: str, limit: int = POOL_LIMIT) -> DataFrame:
    """Like pool_pick(), among the members whose key equals the row's; a row without any is an error."""
    _small(pool, limit)
    fields = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in pool.columns])
    buckets = pool.groupBy(match_key(F.col(theirs)).alias("_k")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order_by).alias("o"), fields.alias("m")))), lambda x: x["m"]).alias("_ms"))
    out = df.withColumn("_m", match_key(F.col(mine))).join(F.broadcast(buckets), F.col("_m") == F.col("_k"), "left")
    n = F.size("_ms")
    none = F.raise_error(F.concat(F.lit("no member of the pool for "), F.coalesce(F.col(mine).cast("string"), F.lit("null"))))
    place = F.when(F.coalesce(n, F.lit(0)) < 1, none.cast("int")).otherwise(F.least(F.floor(u * n), n - 1).cast("int"))
    return out.withColumn("_x", F.get("_ms", place)).select(*df.columns, "_x.*")


def pool_pick_where(df: DataFrame, pool: DataFrame, order_by: str, allowed, u: Column, prefix: str, limit: int = 20_000) -> DataFrame:
    """Like pool_pick(), among the members for which allowed(member struct) holds; a row that has none stops the run.

    The pool is one array that each row filters, so nothing is joined or shuffled; hence the smaller limit.
    """
    _small(pool, limit)
    fields = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in pool.columns])
    whole = pool.select(F.struct(F.col(order_by).alias("o"), fields.alias("m")).alias("x")).agg(F.sort_array(F.collect_list("x")).alias("_all"))
    out = df.crossJoin(F.broadcast(whole)).withColumn("_some", F.filter("_all", lambda x: allowed(x["m"])))
    n = F.size("_some")
    place = F.when(n > 0, F.least(F.floor(u * n), n - 1)).otherwise(F.raise_error(F.lit("no member of the pool is allowed for a row")).cast("long"))
    return out.withColumn("_x", F.get("_some", place.cast("int"))["m"]).select(*df.columns, "_x.*")


def row_link(df: DataFrame, source: DataFrame, order_by: str, place: Column, prefix: str = "", limit: int = POOL_LIMIT) -> DataFrame:
    """Each row with all columns of the source row at `place` (0-based, in order of order_by)."""
    _small(source, limit)
    rows = source.withColumn("_i", F.row_number().over(Window.orderBy(order_by)) - 1).select("_i", *[F.col(c).alias(f"{prefix}{c}") for c in source.columns])
    out = df.withColumn("_n", place.cast("int"))
    return out.join(F.broadcast(rows), out["_n"] == rows["_i"], "left").drop("_n", "_i")


def each(df: DataFrame, items: str, card: Column, stride: int, lane: int = 1, item: str = "item", item_id: str = "_item_id") -> DataFrame:
    """A row for each element of a list column, with a key that leaves gaps: (card - 1) * stride + lane + position. No row for an empty list."""
    out = df.select("*", F.posexplode(items).alias("_pos", item))
    return out.withColumn(item_id, (card.cast("long") - 1) * stride + lane + F.col("_pos")).drop("_pos")


def list_running(items: Column, op: str = "sum", kind: str = "double") -> Column:
    """The running value along a list of numbers of a kind; decimals stay exact."""
    join = {"sum": lambda a, b: (a + b).cast(kind), "min": F.least, "max": F.greatest}[op]
    empty = F.expr(f"cast(array() as array<{kind}>)")
    return F.aggregate(items, empty, lambda s, x: F.concat(s, F.array(F.when(F.size(s) == 0, x.cast(kind)).otherwise(join(F.element_at(s, -1), x)))))
