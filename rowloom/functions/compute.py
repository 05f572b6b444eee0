"""The computing language: a tree of tags over integers, strings and lists, lowered to columns.

A node is (tag, attributes, children, text). Integers are 64 bits and overflow loudly.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list["Node"]
    text: str = ""

    def child(self, tag: str) -> "Node":
        return next(c for c in self.children if c.tag == tag)


@dataclass
class Val:
    kind: str  # int, str, list or bool
    col: Column

    def string(self) -> Column:
        return F.array_join(self.col, "") if self.kind == "list" else self.col.cast("string")

    def whole(self) -> Column:
        """Only a single digit becomes a number by itself."""
        if self.kind == "int":
            return self.col
        return F.when(self.col.rlike("^[0-9]$"), self.col.cast("int").cast("long")).otherwise(F.raise_error(F.lit("a text is no number; use to_number")).cast("long"))


def chars(c: Column) -> Column:
    return F.filter(F.split(c, "", -1), lambda x: x != "")


def divide(a: Column, b: Column) -> Column:
    """Rounded down."""
    r = F.pmod(a, F.abs(b))
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(((a - r) / F.abs(b)).cast("long") * F.signum(b).cast("long") - F.when((b < 0) & (r != 0), 1).otherwise(0))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("remainder of a division by zero")).cast("long")).otherwise(F.pmod(a, F.abs(b)))


def encode(c: Column, how: str) -> Column:
    """One character as a number's text."""
    code = F.ascii(c) if how == "ascii" else F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    if how == "base36":
        return F.when(c.rlike("^[0-9]$"), c).when(F.upper(c).rlike("^[A-Z]$"), (F.ascii(F.upper(c)) - 55).cast("string")).otherwise(F.raise_error(F.lit("not a character of base 36")))
    base = {"ascii": 10, "unicode": 10, "hex": 16, "binary": 2, "octal": 8}[how]
    return F.lower(F.conv(code.cast("string"), 10, base))


class Lowering:
    """look: the columns; names bound by let and the current element of a loop come on top."""

    def __init__(self, look: Callable[[str], Column], types: Callable[[str], str] = lambda _: "str"):
        self.look, self.types = look, types

    def __call__(self, node: Node, env: dict[str, Val] | None = None) -> Val:
        env = env or {}
        f = getattr(self, "_" + node.tag, None)
        if f is None:
            raise ValueError(f"no tag is named {node.tag}")
        return f(node, env)

    def all(self, node, env):
        return [self(c, env) for c in node.children]

    def program(self, node: Node) -> Val:
        """<let name> bindings in order, then <result>."""
        env: dict[str, Val] = {}
        for c in node.children:
            if c.tag == "let":
                env = env | {c.attrs["name"]: self(c.children[0], env)}
            elif c.tag == "result":
                return self(c.children[0], env)
        raise ValueError("compute has no result")

    def _int(self, n, env):
        return Val("int", F.lit(int(n.attrs["v"])).cast("long"))

    def _str(self, n, env):
        return Val("str", F.lit(n.attrs.get("v", n.text)))

    def _list(self, n, env):
        if "v" in n.attrs:
            return Val("list", F.array(*[F.lit(x.strip()) for x in n.attrs["v"].split(n.attrs.get("sep", ","))]))
        return Val("list", F.array(*[v.string() for v in self.all(n, env)]))

    def _field(self, n, env):
        name = n.attrs["name"]
        return Val("int", self.look(name).cast("long")) if name in ("_count", "_total") or self.types(name) == "int" else Val("str", self.look(name).cast("string"))

    def _use(self, n, env):
        return env[n.attrs["name"]]

    def _current(self, n, env):
        return env["."]

    def _current_index(self, n, env):
        return env["#"]

    def _acc(self, n, env):
        return env["+"]

    def _add(self, n, env):
        out = F.lit(0).cast("long")
        for v in self.all(n, env):
            out = out + v.whole()
        return Val("int", out)

    def _subtract(self, n, env):
        first, *rest = self.all(n, env)
        out = first.whole()
        for v in rest:
            out = out - v.whole()
        return Val("int", out)

    def _multiply(self, n, env):
        out = F.lit(1).cast("long")
        for v in self.all(n, env):
            out = out * v.whole()
        return Val("int", out)

    def _divide(self, n, env):
        a, b = self.all(n, env)
        return Val("int", divide(a.whole(), b.whole()))

    def _mod(self, n, env):
        a, b = self.all(n, env)
        return Val("int", modulo(a.whole(), b.whole()))

    def _items(self, n, env) -> Column:
        v = self(n.child("over").children[0] if any(c.tag == "over" for c in n.children) else n.children[0], env)
        return v.col if v.kind == "list" else chars(v.string())

    def _each(self, n, env):
        body = n.child("do").children[0]
        return Val("list", F.transform(self._items(n, env), lambda x, i: self(body, env | {".": Val("str", x), "#": Val("int", i.cast("long"))}).string()))

    def _reduce(self, n, env):
        body, init = n.child("do").children[0], self(n.child("init").children[0], env)
        items = self._items(n, env)
        indexed = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))
        kind = init.kind
        fold = F.aggregate(indexed, init.col, lambda s, e: (lambda v: v.whole() if kind == "int" else v.string())(self(body, env | {".": Val("str", e["x"]), "#": Val("int", e["i"]), "+": Val(kind, s)})))
        return Val(kind, fold)

    def _inner(self, n, env, tag="in") -> Val:
        return self(n.child(tag).children[0], env) if any(c.tag == tag for c in n.children) else self(n.children[0], env)

    def _join(self, n, env):
        return Val("str", F.array_join(self._inner(n, env).col, n.attrs.get("sep", "")))

    def _split(self, n, env):
        if not n.attrs.get("sep"):
            raise ValueError("split needs a separator")
        sep = "\\Q" + n.attrs["sep"] + "\\E"
        return Val("list", F.split(self._inner(n, env).string(), sep, -1))

    def _at(self, n, env):
        v = self._inner(n, env)
        items = v.col if v.kind == "list" else chars(v.string())
        i = self(n.child("index").children[0], env).whole().cast("int")
        other = F.lit(n.attrs["default"]) if "default" in n.attrs else F.raise_error(F.lit("index past the end")).cast("string")
        return Val("str", F.coalesce(F.when(i >= 0, F.get(items, i)), other))

    def _length(self, n, env):
        v = self.all(n, env)[0]
        return Val("int", (F.size(v.col) if v.kind == "list" else F.length(v.string())).cast("long"))

    def _encode(self, n, env):
        return Val("str", encode(self.all(n, env)[0].string(), n.attrs["as"]))

    def _to_number(self, n, env):
        s = self.all(n, env)[0].string()
        return Val("int", F.when(s.rlike(r"^[+-]?\d+$"), s.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a whole number: "), s)).cast("long")))

    def _pad(self, n, env):
        return Val("str", X.pad_left(self.all(n, env)[0].string(), int(n.attrs["width"]), n.attrs.get("fill", "0")))

    def _concat(self, n, env):
        return Val("str", F.concat(*[v.string() for v in self.all(n, env)]))

    def _filter(self, n, env, name, arg=""):
        return Val("str", X.filtered(self.all(n, env)[0].string(), name, arg))

    def _upper(self, n, env):
        return self._filter(n, env, "upper")

    def _lower(self, n, env):
        return self._filter(n, env, "lower")

    def _capitalize(self, n, env):
        return self._filter(n, env, "capitalize")

    def _title(self, n, env):
        return self._filter(n, env, "title")

    def _trim(self, n, env):
        return self._filter(n, env, "trim")

    def _mask(self, n, env):
        return self._filter(n, env, "mask", n.attrs["pattern"])

    def _group(self, n, env):
        return self._filter(n, env, "group", n.attrs["size"] + "," + n.attrs.get("sep", " "))

    def _slice(self, n, env):
        return self._filter(n, env, "slice", n.attrs["from"] + ("," + n.attrs["to"] if "to" in n.attrs else ""))

    def _replace(self, n, env):
        return Val("str", X.swap(self.all(n, env)[0].string(), n.attrs["from"], n.attrs.get("to", "")))

    def _equals(self, n, env):
        a, b = self.all(n, env)
        return Val("bool", a.whole() == b.whole() if a.kind == b.kind == "int" else a.string() == b.string())

    def _less_than(self, n, env):
        a, b = self.all(n, env)
        return Val("bool", a.whole() < b.whole())

    def _greater_than(self, n, env):
        a, b = self.all(n, env)
        return Val("bool", a.whole() > b.whole())

    def _is_digit(self, n, env):
        return Val("bool", self.all(n, env)[0].string().rlike("^[0-9]$"))

    def _choose(self, n, env):
        out, kind = None, None
        for w in n.children:
            if w.tag == "when":
                test, then = self(w.child("test").children[0], env), self(w.child("then").children[0], env)
                kind = kind or then.kind
                value = then.col if then.kind == kind else then.string()
                out = F.when(test.col, value) if out is None else out.when(test.col, value)
            elif w.tag == "otherwise":
                last = self(w.children[0], env)
                out = out.otherwise(last.col if last.kind == kind else last.string())
        return Val(kind or "str", out)
