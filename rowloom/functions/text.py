"""Formatting of cells: filters of interpolation, case and masks."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)^\s+|\s+$"


def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def title(c: Column) -> Column:
    """The first letter of each word; the rest untouched."""
    return F.array_join(F.transform(F.split(c, " ", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), " ")


def cut(c: Column, start: int, stop: int | None = None) -> Column:
    """Code points [start, stop); negative numbers count from the end."""
    n = F.length(c)
    at = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    first, last = at(start), n if stop is None else at(stop)
    return F.substring(c, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))


def swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def trim(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE, "")


def group(c: Column, size: int, sep: str = " ") -> Column:
    """Digits in groups from the right, in the whole part of a number only; other text from the right as it is."""
    number = F.regexp_extract(c, r"^([+-]?\d+)(\.\d+)?$", 1)
    rest = F.regexp_extract(c, r"^([+-]?\d+)(\.\d+)?$", 2)
    quoted = sep.replace("\\", "\\\\").replace("$", "\\$")
    grouped = lambda x: F.regexp_replace(x, rf"(?<=\w)(?=(?:\w{{{size}}})+$)", quoted)
    return F.when(number != "", F.concat(grouped(number), rest)).otherwise(grouped(c))


def compact(c: Column, base: int = 36) -> Column:
    """A whole number up to 2^53 - 1 in another base, in lower case; other text as it is."""
    n = c.try_cast("long")
    sign = F.when(n < 0, "-").otherwise("")
    return F.when(F.abs(n) <= 2**53 - 1, F.concat(sign, F.lower(F.conv(F.abs(n).cast("string"), 10, base)))).otherwise(c)


def csv_field(c: Column, delimiter: str = ",") -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def sql_text(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("''"))


def pad_left(c: Column, width: int, fill: str = " ") -> Column:
    """Never shortens, as lpad would."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


CASES = {"upper": F.upper, "lower": F.lower, "capitalize": upper_first, "title": title}

_SLOT = re.compile(r"\\(?P<esc>.)|(?P<rest>\*)|(?P<kind>[xw])(?:\[(?P<a>-?\d+)(?:\.\.(?P<b>-?\d+))?\])?|(?P<lit>.)", re.S)


def mask_one(pattern: str, value: str) -> str:
    """x: the next character; w: the next word; x[i], w[i..j]: those; *: what is left; else literally."""
    taken = [False] * len(value)
    words = [m.span() for m in re.finditer(r"\S+", value)]
    out = []

    def numbers(a, b, n):
        lo = int(a)
        hi = int(b) if b is not None else lo
        lo, hi = (lo + n if lo < 0 else lo), (hi + n if hi < 0 else hi)
        return [i for i in (range(lo, hi + 1) if lo <= hi else range(lo, hi - 1, -1)) if 0 <= i < n]

    for m in _SLOT.finditer(pattern):
        free = next((i for i, t in enumerate(taken) if not t), len(value))
        if m["esc"] is not None or m["lit"] is not None:
            out.append(m["esc"] or m["lit"])
        elif m["rest"]:
            out.append("".join(c for c, t in zip(value, taken, strict=True) if not t))
            taken = [True] * len(value)
        elif m["a"] is None and m["kind"] == "x":
            if free < len(value):
                out.append(value[free])
                taken[free] = True
        elif m["a"] is None:
            while free < len(value) and not taken[free] and not value[free].isspace():
                out.append(value[free])
                taken[free] = True
                free += 1
            if free < len(value) and not taken[free]:
                taken[free] = True
        elif m["kind"] == "x":
            for i in numbers(m["a"], m["b"], len(value)):
                out.append(value[i])
                taken[i] = True
        else:
            got = []
            for k in numbers(m["a"], m["b"], len(words)):
                a, b = words[k]
                taken[a:b] = [True] * (b - a)
                if b < len(value):
                    taken[b] = True
                elif a:
                    taken[a - 1] = True
                got.append(value[a:b])
            out.append(" ".join(got))
    return "".join(out)


def mask(c: Column, pattern: str) -> Column:
    """A mask that only copies and adds stays in the plan; one with words, indexes or a rest goes through Arrow."""
    if re.fullmatch(r"(?:[^\\*xw]|x(?!\[))*", pattern):
        parts, i = [], 0
        for p in re.findall(r"x+|[^x]+", pattern):
            if p[0] == "x":
                parts.append(F.substring(c, i + 1, len(p)))
                i += len(p)
            else:
                parts.append(F.lit(p))
        return F.concat(*parts) if parts else F.when(c.isNotNull(), F.lit(""))

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else mask_one(pattern, v))

    return apply(c)


def filtered(c: Column, name: str, arg: str = "") -> Column:
    """A filter of interpolation by name."""
    args = arg.split(",") if arg else []
    if name in CASES:
        return CASES[name](c)
    if name == "slice":
        return cut(c, int(args[0]), int(args[1]) if len(args) > 1 else None)
    if name == "replace":
        return swap(c, args[0], args[1] if len(args) > 1 else "")
    if name == "trim":
        return trim(c)
    if name == "group":
        return group(c, int(args[0]), arg.split(",", 1)[1] if len(args) > 1 else " ")
    if name == "compact":
        return compact(c, int(args[0]) if args else 36)
    if name == "csv":
        return csv_field(c, arg or ",")
    if name == "sql":
        return sql_text(c)
    if name == "mask":
        return mask(c, arg)
    raise ValueError(f"no filter is named {name}")
