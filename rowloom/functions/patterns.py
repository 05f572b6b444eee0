"""Finite patterns turned into generators: each row draws one text that the pattern matches."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import apportion, rng

ALPHABETS = {
    "latin.lower": "abcdefghijklmnopqrstuvwxyz", "latin.upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "hex": "0123456789abcdef",
    "cyrillic.lower": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "cyrillic.upper": "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "greek.lower": "αβγδεζηθικλμνξοπρστυφχψω", "greek.upper": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
}
ALPHABETS["latin"] = ALPHABETS["latin.lower"] + ALPHABETS["latin.upper"]
ALPHABETS["latin.alnum"] = ALPHABETS["latin"] + ALPHABETS["digits"]
_ESCAPES = {"d": "0123456789", "w": ALPHABETS["latin.alnum"] + "_", "s": " "}


def char_class(body: str) -> str:
    """The characters of [a-z0-9_] and the like; a leading ^ takes them out of printable ASCII."""
    out, i, inverse = [], 0, body.startswith("^")
    i = int(inverse)
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            out += _ESCAPES.get(body[i + 1], body[i + 1])
            i += 2
        elif i + 2 < len(body) and body[i + 1] == "-":
            if ord(body[i + 2]) < ord(c):
                raise ValueError(f"the range {body[i:i + 3]!r} is empty")
            out += [chr(k) for k in range(ord(c), ord(body[i + 2]) + 1)]
            i += 3
        else:
            out.append(c)
            i += 1
    chars = dict.fromkeys(out)
    if inverse:
        return "".join(chr(k) for k in range(32, 127) if chr(k) not in chars)
    return "".join(chars)


class Parser:
    """("lit", s) ("set", chars) ("seq", nodes) ("or", nodes) ("rep", node, m, n) ("group", n, node) ("back", n) ("weights", [(share, text)])."""

    def __init__(self, text: str):
        self.s, self.i, self.groups = text, 0, 0

    def parse(self):
        out = self.alternatives()
        if self.i < len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} in the pattern")
        return out

    def alternatives(self):
        branches = [self.sequence()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("or", branches)

    def sequence(self):
        out = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            out.append(self.repeated(self.atom()))
        return ("seq", out)

    def repeated(self, node):
        if self.i < len(self.s):
            c = self.s[self.i]
            if c in "*+":
                raise ValueError("a pattern that may repeat without end can't be drawn from")
            if c == "?":
                self.i += 1
                return ("rep", node, 0, 1)
            if c == "{" and "}" in self.s[self.i:]:
                body = self.s[self.i + 1:self.s.index("}", self.i)]
                low, _, high = body.partition(",")
                if low.strip().isdigit() and (not high or high.strip().isdigit()):
                    if body.endswith(","):
                        raise ValueError("a pattern that may repeat without end can't be drawn from")
                    self.i += len(body) + 2
                    return ("rep", node, int(low), int(high or low))
        return node

    def atom(self):
        c = self.s[self.i]
        self.i += 1
        if c == "(":
            if self.s.startswith("?%{", self.i):
                end = self.s.index("})", self.i)
                parts = [x.partition(":") for x in self.s[self.i + 3:end].split(";")]
                self.i = end + 2
                return ("weights", [(float(a) if a.strip() else None, b) for a, _, b in parts])
            number = 0
            if self.s.startswith("?:", self.i):
                self.i += 2
            else:
                self.groups += 1
                number = self.groups
            inner = self.alternatives()
            if self.i >= len(self.s):
                raise ValueError("a group of the pattern is not closed")
            self.i += 1
            return ("group", number, inner)
        if c == "[":
            end = self.i
            while end < len(self.s) and (self.s[end] != "]" or self.s[end - 1] == "\\"):
                end += 1
            body = self.s[self.i:end]
            self.i = end + 1
            return ("set", char_class(body))
        if c == "\\":
            e = self.s[self.i]
            self.i += 1
            if e == "a" and self.s.startswith("{", self.i):
                end = self.s.index("}", self.i)
                name = self.s[self.i + 1:end]
                self.i = end + 1
                return ("set", ALPHABETS[name])
            if e in "123456789":
                return ("back", int(e))
            return ("set", _ESCAPES[e]) if e in _ESCAPES else ("lit", e)
        if c == ".":
            return ("set", ALPHABETS["latin.alnum"])
        return ("lit", c)


def longest(node) -> int:
    kind = node[0]
    if kind == "lit":
        return len(node[1])
    if kind in ("set",):
        return 1
    if kind == "seq":
        return sum(map(longest, node[1]))
    if kind == "or":
        return max(map(longest, node[1]))
    if kind == "rep":
        return longest(node[1]) * node[3]
    if kind == "group":
        return longest(node[2])
    if kind == "weights":
        return max(len(t) for _, t in node[1])
    return 64


class Drawing:
    """The column of a pattern. n: rows for whole-column shares of weighted choices, with `place` the row's number among them."""

    def __init__(self, seed: str, stream: str, row: Column, n: int | None = None, place: Column | None = None):
        self.seed, self.stream, self.row, self.n, self.place, self.k = seed, stream, row, n, place, 0
        self.groups: dict[int, Column] = {}

    def u(self) -> Column:
        self.k += 1
        return rng.uniform(self.seed, self.stream, self.row, self.k)

    def one_of(self, chars: str) -> Column:
        return F.substring(F.lit(chars), (F.least(F.floor(self.u() * len(chars)), F.lit(len(chars) - 1)) + 1).cast("int"), F.lit(1))

    def __call__(self, node) -> Column:
        kind = node[0]
        if kind == "lit":
            return F.lit(node[1])
        if kind == "set":
            return self.one_of(node[1])
        if kind == "seq":
            return F.concat(*[self(x) for x in node[1]]) if node[1] else F.lit("")
        if kind == "group":
            out = self(node[2])
            self.groups[node[1]] = out
            return out
        if kind == "back":
            return self.groups[node[1]]
        if kind == "or":
            u = self.u()
            out = None
            for i, b in enumerate(node[1], 1):
                c = self(b)
                out = F.when(u < i / len(node[1]), c) if out is None else out.when(u < i / len(node[1]), c)
            return out.otherwise(self(node[1][-1]))
        if kind == "rep":
            low, high = node[2], node[3]
            fixed = [self(node[1]) for _ in range(low)]
            if high > low:
                n = F.floor(self.u() * (high - low + 1))
                fixed += [F.when(n > i, self(node[1])).otherwise("") for i in range(high - low)]
            return F.concat(*fixed) if fixed else F.lit("")
        shares = apportion.shares(",".join("" if a is None else str(a) for a, _ in node[1]), len(node[1]))
        self.k += 1
        stream = f"{self.stream}%{self.k}"
        return apportion.pick(rng.slot(self.seed, stream, self.n, self.place), apportion.counts(self.n, shares, self.seed, stream), [t for _, t in node[1]])


def draw(pattern: str, seed: str, stream: str, row: Column, n: int | None = None, place: Column | None = None, limit: int = 1000) -> Column:
    node = Parser(pattern).parse()
    if longest(node) > limit:
        raise ValueError(f"the pattern's texts may be longer than {limit}")
    return Drawing(seed, stream, row, n, place)(node)
