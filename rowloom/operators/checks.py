"""Statistics of whole columns, uniqueness, imperfections and checks of a run."""
from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng


def filled(c: Column) -> Column:
    """NULL for cells that are empty or blank."""
    return F.when(F.trim(c.cast("string")) != "", c)


def stats(df: DataFrame, column: str, ops: list[str], scale: int | None = None) -> DataFrame:
    """One row: the statistics of the non-empty cells. With a scale, sums are exact decimals."""
    c = filled(F.col(column))
    value = c.cast(f"decimal(38,{scale})") if scale is not None else c.cast("double")
    all_ = {"sum": F.sum(value), "min": F.min(value), "max": F.max(value), "mean": F.avg(c.cast("double")), "median": F.median(c.cast("double")), "stddev": F.stddev_pop(c.cast("double")), "count": F.count(c)}
    return df.agg(*[all_[o].alias(o) for o in ops])


def with_stat(df: DataFrame, column: str, op: str, name: str, scale: int | None = None) -> DataFrame:
    """The statistic on every row: one row is joined to all."""
    return df.crossJoin(F.broadcast(stats(df, column, [op], scale).withColumnRenamed(op, name)))


def missing(c: Column, u: Column, share: float, token: str = "") -> Column:
    return F.when(u < share, F.lit(token)).otherwise(c)


def anomaly(c: Column, u: Column, share: float, factor: float = 10.0) -> Column:
    """Numeric cells of a share of rows times the factor, rounded half away from zero to their decimals (12 at most), with their width; words stay."""
    number = c.rlike(r"^[+-]?\d+(\.\d+)?$")
    decimals = F.length(F.regexp_extract(c, r"\.(\d+)$", 1))
    by = Decimal(str(factor))
    exact = F.when(number, c).cast("decimal(24,12)") * F.lit(format(by, "f")).cast(f"decimal(13,{min(12, max(0, -by.as_tuple().exponent))})")
    out = F.round(exact, 0).cast("decimal(38,0)").cast("string")
    for d in range(1, 13):
        out = F.when(decimals == d, F.round(exact, d).cast(f"decimal(38,{d})").cast("string")).otherwise(out)
    width = F.length(c)
    padded = F.when(c.rlike(r"^0\d") & (F.length(out) < width), F.lpad(out, width, F.lit("0"))).otherwise(out)
    return F.when((u < share) & number, padded).otherwise(c)


def anomaly_flag(c: Column, u: Column, share: float, missing_u: Column | None = None, missing_share: float = 0.0) -> Column:
    """What happened: changed, and not blanked afterwards."""
    hit = (u < share) & c.rlike(r"^[+-]?\d+(\.\d+)?$")
    return hit & ~(missing_u < missing_share) if missing_u is not None else hit


def space_of(sizes: list[int], n: int) -> int:
    """How many combinations there are; an error where n rows need more."""
    space = math.prod(sizes)
    if n > space:
        raise ValueError(f"{n} rows need distinct combinations; only {space} exist")
    return space


def digits(x: Column, sizes: list[int]) -> list[Column]:
    """One place for each field from a number below their product."""
    out, base = [], 1
    for s in sizes:
        out.append(F.pmod(F.floor(x / F.lit(base)).cast("long") if base > 1 else x, F.lit(s)))
        base *= s
    return out


def combinations(row: Column, sizes: list[int], n: int, seed: str, stream: str) -> list[Column]:
    """One place for each field, no two rows the same: the digits of a permuted number. n rows at most the product of sizes."""
    return digits(rng.slot(seed, stream, space_of(sizes, n), row), sizes)


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """The combinations that occur on more rows than one."""
    return df.groupBy(*columns).count().where("count > 1")


#: Attempts at a value that differs within the row, the first draw included.
ATTEMPTS = 100
#: Attempts with a stream of their own; the later ones share one, and are drawn only where all of these are taken.
APART = 12


def later(draw) -> Column:
    """The list of a field's attempts beyond the first APART, by number."""
    return F.transform(F.sequence(F.lit(APART).cast("long"), F.lit(ATTEMPTS - 1).cast("long")), draw)


def differing(draws: list[list[Column]], more: list[Column]) -> Column:
    """A list: for each field the first of its attempts, those of more last, that no earlier field of the row took; an error when all are taken."""
    let = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    none = F.raise_error(F.lit("no value is left that differs within the row"))

    def chosen(attempts: list[Column], rest: Column):
        def add(taken: Column) -> Column:
            free = lambda some: F.get(F.filter(some, lambda x: ~F.array_contains(taken, x)), 0)
            return F.concat(taken, F.array(F.coalesce(free(F.array(*attempts)), free(rest), none)))
        return add

    out = F.array(draws[0][0])
    for attempts, rest in zip(draws[1:], more[1:], strict=True):
        out = let(out, chosen(attempts, rest))
    return out


def sample_list(values: list[str], weights: list[float] | None, k: Column, row: Column, seed: str, stream: str) -> Column:
    """k distinct values for a row, weighted: the least of -ln(u) / w come first."""
    w = weights or [1.0] * len(values)
    keyed = F.array(*[F.struct((-F.ln(rng.uniform(seed, f"{stream}#{i}", row)) / float(x)).alias("k"), F.lit(v).alias("v")) for i, (v, x) in enumerate(zip(values, w, strict=True)) if x > 0])
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), k.cast("int")), lambda x: x["v"])


def constants(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The single value of each column; a column that varies or has empty cells is an error."""
    aggs = [f(F.col(c).cast("string")).alias(f"{p}{c}") for c in columns for p, f in (("a", F.min), ("b", F.max))]
    aggs += [F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"e{c}") for c in columns]
    r = df.agg(*aggs).first().asDict()
    for c in columns:
        if r["a" + c] != r["b" + c] or r["e" + c]:
            raise ValueError(f"{c} is not the same on every row")
    return {c: r["a" + c] for c in columns}


def check(df: DataFrame, that: str, says: str) -> None:
    """Stops the run with the message unless the expression over its constants holds."""
    from ..functions import expr

    tree = expr.parse(that)
    names = sorted(n for n in expr.names(tree) if n in df.columns)
    known = constants(df, names) if names else {}
    value = expr.Lowering({k: expr.from_text(F.lit(v)) for k, v in known.items()}.get)(tree)
    if not df.sparkSession.range(1).select(expr.truth(value).alias("ok")).first().ok:
        raise AssertionError(says)
