"""The expression language of conditions and formulas, lowered to columns.

Cells are text. A value carries up to three readings: its text, its number (NULL if it is
none) and its exact integer (NULL if it isn't written as one). Comparison is loose: integers
as integers, a number against numeric text as numbers, all else as text; `===` compares characters.
"""
from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+|\.\d+|\d+)|(?P<str>'[^']*'|"[^"]*")|(?P<name>[^\W\d]\w*(?:\.\w+)*)|(?P<op>===|!==|==|!=|<=|>=|&&|\|\||[-+*/%<>!?:(),\[\]]))""")
_BINDING = {"||": 1, "&&": 2, "==": 3, "!=": 3, "===": 3, "!==": 3, "in": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read {text[at:at + 20]!r} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class Parser:
    """Precedence climbing; trees are tuples: ("num", text), ("str", text), ("name", text), ("call", f, args), ("list", items), ("un", op, x), ("bin", op, x, y), ("if", c, a, b)."""

    def __init__(self, text: str):
        self.t, self.i = tokens(text), 0

    def take(self, value: str | None = None):
        kind, got = self.t[self.i]
        if value is not None and got != value:
            raise ValueError(f"expected {value!r}, found {got!r}")
        self.i += 1
        return kind, got

    def parse(self):
        out = self.ternary()
        if self.t[self.i][0] != "end":
            raise ValueError(f"unexpected {self.t[self.i][1]!r}")
        return out

    def ternary(self):
        c = self.binary(1)
        if self.t[self.i][1] == "?":
            self.take()
            a = self.ternary()
            self.take(":")
            return ("if", c, a, self.ternary())
        return c

    def binary(self, least: int):
        left = self.unary()
        while (op := self.t[self.i][1]) in _BINDING and self.t[self.i][0] != "str" and _BINDING[op] >= least:
            self.take()
            left = ("bin", op, left, self.binary(_BINDING[op] + 1))
        return left

    def unary(self):
        kind, got = self.t[self.i]
        if kind == "op" and got in "!-+":
            self.take()
            return ("un", got, self.unary())
        return self.primary()

    def items(self, close: str):
        out = []
        while self.t[self.i][1] != close:
            out.append(self.ternary())
            if self.t[self.i][1] != close:
                self.take(",")
        self.take(close)
        return out

    def primary(self):
        kind, got = self.take()
        if kind == "num":
            return ("num", got)
        if kind == "str":
            return ("str", got[1:-1])
        if got == "(":
            out = self.ternary()
            self.take(")")
            return out
        if got == "[":
            return ("list", self.items("]"))
        if kind == "name":
            if self.t[self.i] == ("op", "("):
                self.take()
                return ("call", got, self.items(")"))
            return ("name", got)
        raise ValueError(f"unexpected {got!r}")


def parse(text: str):
    return Parser(text).parse()


def names(tree) -> set[str]:
    if isinstance(tree, tuple):
        return {tree[1]} if tree[0] == "name" else set().union(*(names(x) for x in tree[1:])) if len(tree) > 1 else set()
    return set().union(*(names(x) for x in tree)) if isinstance(tree, list) and tree else set()


@dataclass
class Value:
    kind: str  # num, text, bool or list
    text: Column
    num: Column | None = None
    int: Column | None = None
    items: Column | None = None


def plain_number(c: Column) -> Column:
    """A double as it is written: whole numbers without a point."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def as_number(text: Column) -> Column:
    """Text as a number: spaces trimmed, '' is 0, hexadecimal after 0x; NULL if it is none."""
    t = F.trim(text)
    hexa = F.conv(F.substring(t, 3, 16), 16, 10).cast("double")
    plain = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.when(t == "", F.lit(0.0)).when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), hexa).otherwise(plain)


def from_text(c: Column) -> Value:
    t = F.trim(c)
    return Value("text", c, as_number(c), F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long")))


def from_column(c: Column, kind: str = "string") -> Value:
    """A column by its Spark type: whole numbers and doubles keep theirs, all else is text."""
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return Value("num", c.cast("string"), c.cast("double"), c.cast("long"))
    if kind in ("double", "float") or kind.startswith("decimal"):
        return Value("num", plain_number(c.cast("double")), c.cast("double"))
    if kind == "boolean":
        return boolean(c)
    if kind.startswith("array"):
        return Value("list", F.array_join(c, ","), items=c.cast("array<string>"))
    return from_text(c.cast("string"))


def boolean(c: Column) -> Value:
    c = F.coalesce(c, F.lit(False))
    return Value("bool", F.when(c, "true").otherwise("false"), c.cast("double"))


def number(c: Column, whole: Column | None = None) -> Value:
    if whole is None:
        return Value("num", plain_number(c), c)
    return Value("num", F.coalesce(whole.cast("string"), plain_number(c)), c, whole)


def truth(v: Value) -> Column:
    """'' and 'false' and nothing are false; '0' is true."""
    return F.coalesce((v.text != "") & (v.text != "false"), F.lit(False))


def equal(a: Value, b: Value) -> Column:
    x, y = F.coalesce(a.text, F.lit("")), F.coalesce(b.text, F.lit(""))
    out = None
    if a.int is not None and b.int is not None:
        out = F.when(a.int.isNotNull() & b.int.isNotNull(), a.int == b.int)
    if a.num is not None and b.num is not None and "num" in (a.kind, b.kind):
        both = a.num.isNotNull() & b.num.isNotNull()
        out = F.when(both, a.num == b.num) if out is None else out.when(both, a.num == b.num)
    return x == y if out is None else out.otherwise(x == y)


def _arith(op: str, a: Value, b: Value) -> Value:
    if a.num is None or b.num is None:
        raise ValueError(f"{op} needs numbers")
    whole = None
    if a.int is not None and b.int is not None:
        whole = {"+": a.int + b.int, "-": a.int - b.int, "*": a.int * b.int}.get(op)
    if op == "/":
        x, y = a.num, b.num
        return number(F.when(y != 0, x / F.when(y != 0, y)).when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan")))
    if op == "%":
        zero = F.raise_error(F.lit("remainder of a division by zero"))
        real = F.when(b.num == 0, zero.cast("double")).otherwise(F.pmod(a.num, F.abs(b.num)))
        if a.int is not None and b.int is not None:
            whole = F.when(b.int == 0, zero.cast("long")).otherwise(F.pmod(a.int, F.abs(b.int)))
        return number(real, whole)
    real = {"+": a.num + b.num, "-": a.num - b.num, "*": a.num * b.num}[op]
    if op == "+" and "text" in (a.kind, b.kind):
        text = F.coalesce(whole.cast("string") if whole is not None else F.lit(None), plain_number(real), F.concat(a.text, b.text))
        return Value("text", text, real, whole)
    return number(real, whole)


def _round(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c) + 0.5)


_MATH: dict[str, Callable] = {n: getattr(F, n) for n in "exp log1p expm1 cbrt sin cos tan sinh cosh tanh asinh degrees radians".split()}
_MATH |= {"sign": F.signum, "log": F.ln, "log2": F.log2, "log10": F.log10, "asin": F.asin, "acos": F.acos, "atan": F.atan, "acosh": F.acosh, "atanh": F.atanh, "sqrt": F.sqrt}
_EXACT = {"abs": F.abs, "ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double"), "round": _round, "trunc": lambda c: F.signum(c) * F.floor(F.abs(c))}


def _numbers(v: Value) -> Column:
    return F.transform(v.items, lambda x: F.trim(x).try_cast("double"))


def _list_stat(name: str, v: Value) -> Value:
    if name == "count":
        return number(F.size(v.items).cast("double"), F.size(v.items).cast("long"))
    x = _numbers(v)
    n, total = F.size(x), F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    if name == "sum":
        return number(total)
    if name == "mean":
        return number(F.when(n > 0, total / n))
    if name == "median":
        s = F.array_sort(x)
        return number(F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2))
    if name == "stddev":
        mean = total / n
        return number(F.when(n > 0, F.sqrt(F.aggregate(F.transform(x, lambda y: (y - mean) * (y - mean)), F.lit(0.0), lambda s, y: s + y) / n)))
    return number(F.array_min(x) if name == "min" else F.array_max(x))


class Lowering:
    """look: a name to its Value, or None; a word that names nothing is itself."""

    def __init__(self, look: Callable[[str], Value | None]):
        self.look = look

    def __call__(self, tree) -> Value:
        return getattr(self, "_" + tree[0])(*tree[1:])

    def _num(self, text):
        c = F.lit(float(text))
        return Value("num", F.lit(text), c, F.lit(int(text)).cast("long") if text.isdigit() and len(text) < 19 else None)

    def _str(self, text):
        return from_text(F.lit(text))

    def _name(self, name):
        if name in ("true", "false"):
            return boolean(F.lit(name == "true"))
        if name == "null":
            return Value("text", F.lit(None).cast("string"), F.lit(None).cast("double"))
        found = self.look(name)
        if found is None and "." in name:
            subject, _, value = name.partition(".")
            if (column := self.look(subject)) is not None:
                return boolean(column.text == value)
        return found if found is not None else from_text(F.lit(name))

    def _list(self, items):
        vs = [self(x) for x in items]
        return Value("list", F.concat_ws(",", *[v.text for v in vs]), items=F.array(*[v.text for v in vs]) if vs else F.expr("cast(array() as array<string>)"))

    def _un(self, op, x):
        v = self(x)
        if op == "!":
            return boolean(~truth(v))
        return v if op == "+" else number(-v.num, None if v.int is None else -v.int)

    def _if(self, c, a, b):
        c, a, b = truth(self(c)), self(a), self(b)
        both = lambda x, y: None if x is None or y is None else F.when(c, x).otherwise(y)
        return Value(a.kind if a.kind == b.kind else "text", F.when(c, a.text).otherwise(b.text), both(a.num, b.num), both(a.int, b.int), both(a.items, b.items))

    def _bin(self, op, x, y):
        if op == "in":
            a, items = self(x), y[1] if y[0] == "list" else None
            if items is None:
                return boolean(F.array_contains(self(y).items, a.text))
            out = F.lit(False)
            for i in items:
                out = out | equal(a, self(i))
            return boolean(out)
        a, b = self(x), self(y)
        if op in ("==", "!="):
            c = equal(a, b)
            return boolean(c if op == "==" else ~c)
        if op in ("===", "!=="):
            c = F.coalesce(a.text, F.lit("")) == F.coalesce(b.text, F.lit(""))
            return boolean(c if op == "===" else ~c)
        if op in ("&&", "||"):
            return boolean(truth(a) & truth(b) if op == "&&" else truth(a) | truth(b))
        if op in ("<", ">", "<=", ">="):
            m, n = a.num, b.num
            real = {"<": m < n, ">": m > n, "<=": m <= n, ">=": m >= n}[op]
            if a.int is not None and b.int is not None:
                i, j = a.int, b.int
                real = F.coalesce({"<": i < j, ">": i > j, "<=": i <= j, ">=": i >= j}[op], real)
            return boolean(real)
        return _arith(op, a, b)

    def _call(self, f, args):
        v = [self(a) for a in args]
        if f in ("sum", "mean", "median", "stddev", "count") or (f in ("min", "max") and len(v) == 1 and v[0].kind == "list"):
            if len(v) == 1 and v[0].kind == "list":
                return _list_stat(f, v[0])
            return _list_stat(f, Value("list", F.lit(""), items=F.array(*[x.text for x in v])))
        if f in ("min", "max"):
            pickf = F.least if f == "min" else F.greatest
            whole = pickf(*[x.int for x in v]) if all(x.int is not None for x in v) and len(v) > 1 else None
            return number(pickf(*[x.num for x in v]) if len(v) > 1 else v[0].num, whole)
        if f in _EXACT:
            x = v[0]
            return number(_EXACT[f](x.num), None if x.int is None else (F.abs(x.int) if f == "abs" else x.int))
        if f in _MATH:
            return number(_MATH[f](v[0].num))
        if f in ("pow", "hypot", "atan2"):
            return number(getattr(F, f)(v[0].num, v[1].num))
        if f in SPECIAL:
            return number(special(f)(*[x.num for x in v]))
        t = F.coalesce(v[0].text, F.lit("")) if v else None
        if f == "len":
            n = F.size(v[0].items) if v[0].kind == "list" else F.length(t)
            return number(n.cast("double"), n.cast("long"))
        if f == "is_empty":
            return boolean(t == "")
        if f in ("starts_with", "ends_with", "contains"):
            g = {"starts_with": t.startswith, "ends_with": t.endswith, "contains": t.contains}[f]
            return boolean(g(v[1].text))
        if f in ("lower", "upper"):
            return from_text(getattr(F, f)(t))
        if f == "split":
            quoted = F.concat(F.lit("\\Q"), v[1].text, F.lit("\\E"))
            return Value("list", t, items=F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(t, quoted, -1)))
        if f == "join":
            return from_text(F.array_join(v[0].items, args[1][1] if len(args) > 1 and args[1][0] == "str" else ","))
        if f == "at":
            i = v[1].num
            bad = F.raise_error(F.lit("at() needs a whole number of 0 or more")).cast("string")
            return from_text(F.when((i < 0) | (i != F.floor(i)), bad).otherwise(F.coalesce(F.get(v[0].items, i.cast("int")), F.lit(""))))
        raise ValueError(f"no function is named {f}")


SPECIAL = {"erf", "erfc", "gamma", "lgamma", "beta", "digamma", "zeta"}


def special(name: str):
    """Functions that Spark lacks, over Arrow batches."""
    import numpy as np


    from .special import FUNCTIONS

    f = np.vectorize(FUNCTIONS[name], otypes=[float])

    @F.pandas_udf("double")
    def one(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.astype(float)), dtype=float)

    @F.pandas_udf("double")
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(f(x.astype(float), y.astype(float)), dtype=float)

    return two if name == "beta" else one


def lower(text: str, columns: dict[str, Value]) -> Value:
    return Lowering(columns.get)(parse(text))


def of_frame(df, text: str) -> Value:
    """An expression over the columns of a DataFrame."""
    return lower(text, {n: from_column(df[n], t) for n, t in df.dtypes})
