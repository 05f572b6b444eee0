"""A description lowered to one lazy DataFrame: rows from a range, columns in order of declaration.

Each draw is keyed by seed, column and row. Exact shares are slots of a keyed permutation; a
sub-population keeps its rank and size, known to the driver where the parent is itself a
split, counted otherwise. Joins appear only for pools and linked rows, windows only for running values.
"""
from __future__ import annotations

import os
import re
import secrets
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import apportion, compute, dates, expr, patterns, rng, shapes
from ..functions import text as X
from ..functions.compute import Node
from ..operators import checks, prefix, relate
from ..sources import files
from . import sinks
from .config import ConfigError, read, validate

ID = "_id"
STRIDE = 64  # elements of a list, at most


@dataclass
class Domain:
    """The rows that a column exists on: the condition (None: all), each one's rank from 0, and how many there are."""

    cond: Column | None
    rank: Column
    n: int


@dataclass
class Info:
    """A declared column: its internal name; what else is known of it."""

    name: str
    kind: str = "text"  # text, int, double, bool, date
    decimals: int | None = None
    stamp: str | None = None  # the instant of a date
    items: str | None = None  # the elements of a list
    most: int = 0  # of its elements
    split: dict[str, tuple[int, int]] = field(default_factory=dict)  # value: (first slot, size)
    place: str | None = None  # slot of the row, for split
    nullable: bool = False  # cells may be blank
    absent: bool = False  # it exists on some rows only


class Run:
    """The rows of a description. Overrides win over what it says.

    Without a seed one is invented, and without `now` the clock is read once; both are kept as attributes, so a run can be repeated.
    """

    def __init__(self, spark: SparkSession, source: str, *, count: int | None = None, seed: str | None = None, locale: str | None = None, now: datetime | None = None, data: list[str] | None = None, partitions: int | None = None, rows: DataFrame | None = None):
        self.spark = spark
        text, self.base = (source, os.getcwd()) if source.lstrip().startswith("<") else (open(source, encoding="utf-8").read(), os.path.dirname(os.path.abspath(source)))
        self.root = read(text)
        if errors := validate(self.root):
            raise errors[0]
        self.env = next(c for c in self.root.children if c.tag == "env")
        a = self.env.attrs
        self.count = int(a.get("count", 1)) if count is None else count
        self.seed = seed if seed is not None else a["seed"] if "seed" in a else secrets.token_hex(8)
        self.locale = locale or a.get("local", "en")
        self.now = now or datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
        self.roots = data or []
        self.packs = files.Packs(self.roots, self.locale)
        marker = a.get("inject", "${{%}}").split("%")
        self.slot_text = re.compile(re.escape(marker[0]) + r"(.+?)" + re.escape(marker[1]), re.S)
        self.streaming = rows is not None
        self.ids = (0, max(0, self.count - 1))
        self.df = rows if rows is not None else spark.range(0, self.count, 1, partitions).withColumnRenamed("id", ID)
        self.info: dict[str, Info] = {}
        self.pools: dict[str, DataFrame] = {}
        self.links: dict[str, tuple[str, list | None, int]] = {}
        self.shared: dict[str, tuple[str, int, str]] = {}
        self.used = 0
        self.narrow = False
        self._build()

    # --- names ---

    def fresh(self) -> str:
        self.used += 1
        return f"c{self.used}"

    def put(self, name: str, column: Column, **known) -> Info:
        i = Info(self.fresh(), **known)
        i.absent = i.absent or self.narrow
        self.df = self.df.withColumn(i.name, column)
        self.info[name] = i
        return i

    def look(self, name: str) -> expr.Value | None:
        if name in ("_count", "_total", "_first", "_last"):
            c = {"_count": F.col(ID) + 1, "_total": F.lit(self.count).cast("long"), "_first": F.col(ID) == 0, "_last": F.col(ID) == self.count - 1}[name]
            return expr.from_column(c, "boolean" if name in ("_first", "_last") else "bigint")
        if name not in self.info:
            return None
        i = self.info[name]
        v = expr.from_text(F.col(i.name))
        if i.items:
            v = expr.Value("list", v.text, v.num, v.int, F.col(i.items))
        return v

    def cell(self, name: str) -> Column:
        v = self.look(name)
        if v is None:
            raise ConfigError("E040", f"{name} is not declared above")
        return v.text

    def truth(self, text: str) -> Column:
        return expr.truth(expr.Lowering(self.look)(expr.parse(text)))

    def _whole(self, what: str):
        if self.streaming:
            raise ConfigError("E090", f"{what} needs all rows; a stream has no end")

    # --- building ---

    def everything(self) -> Domain:
        return Domain(None, F.col(ID), self.count)

    def _build(self):
        for c in self.env.children:
            if c.tag == "pool":
                self._pool(c)
        for c in self.env.children:
            if c.tag in ("sequence", "mix", "switch"):
                self._sequence(c, self.everything())
            elif c.tag == "distinct":
                self._distinct([x.strip() for x in c.attrs["of"].split(",")] if "of" in c.attrs else [x.attrs["name"] for x in c.children])
            elif c.tag == "uniq":
                self._uniq_check([x.strip() for x in c.attrs["of"].split(",")] if "of" in c.attrs else [x.attrs["name"] for x in c.children])
        for c in self.env.children:
            if c.tag == "assert":
                self._assert(c)

    def _pool(self, node: Node):
        n = int(node.attrs.get("count", 10))
        if n > relate.POOL_LIMIT:
            raise ConfigError("E050", f"a pool has at most {relate.POOL_LIMIT} members")
        inner = Node("tdc", {}, [Node("env", {"count": str(n), "seed": f"{self.seed}#pool:{node.attrs['name']}", "local": self.locale}, node.children)])
        sub = object.__new__(Run)
        sub.__dict__.update(self.__dict__)
        sub.count, sub.seed, sub.env, sub.info, sub.used, sub.streaming = n, f"{self.seed}#pool:{node.attrs['name']}", inner.children[0], {}, 0, False
        sub.pools = dict(self.pools)
        sub.df = self.spark.range(0, n, 1, 1).withColumnRenamed("id", ID)
        sub._build()
        self.pools[node.attrs["name"]] = sub.table(keep_id=True)

    def _domain(self, node: Node, outer: Domain) -> Domain:
        parent = node.attrs.get("parent")
        if not parent:
            return outer
        if parent in self.info:
            subject, value = parent, None
        else:
            subject, _, value = parent.rpartition(".")
        i = self.info.get(subject)
        if i is None:
            raise ConfigError("E016", f"the parent {parent} is not declared above")
        cond = F.col(i.name).isNotNull() if value is None else F.coalesce(F.col(i.name) == value, F.lit(False))
        if value is not None and value in i.split and outer.cond is None:
            first, size = i.split[value]
            return Domain(cond, F.col(i.place) - first, size)
        return self._ranked(cond if outer.cond is None else cond & outer.cond)

    def _ranked(self, cond: Column) -> Domain:
        """A sub-population whose size must be counted."""
        self._whole("a share of a sub-population")
        name = self.fresh()
        n = self.df.where(cond).count()
        self.df = prefix.running(self.df, ID, F.when(cond, 1).otherwise(0).cast("long"), name, known=self.ids)
        return Domain(cond, F.col(name) - 1, n)

    def _sequence(self, node: Node, outer: Domain):
        name = node.attrs["name"]
        domain = self._domain(node, outer)
        self.narrow = domain.cond is not None
        if node.tag == "mix":
            return self._mix(node, name, domain)
        if node.tag == "switch":
            return self._switch(node, name, domain)
        gens = [c for c in node.children if c.tag == "gen"]
        parts = [c for c in node.children if c.tag in ("gen", "data")]
        if node.children and node.children[0].tag == "compute":
            v = compute.Lowering(lambda n: F.col(ID) + 1 if n == "_count" else F.lit(self.count) if n == "_total" else self.cell(n)).program(node.children[0])
            return self.put(name, self._only(domain, v.string()), kind="int" if v.kind == "int" else "text")
        if any("if" in g.attrs for g in gens):
            return self._conditional(gens, name, domain)
        if node.attrs.get("uniq") == "true":
            return self._uniq(parts, name, domain)
        if len(parts) == 1 and "name" not in parts[0].attrs and parts[0].tag == "gen":
            return self._plain(parts[0], name, name, domain)
        if parts and all("name" in p.attrs for p in parts):
            for p in parts:
                self._part(p, f"{name}.{p.attrs['name']}", f"{name}.{p.attrs['name']}", domain)
            for d in (c for c in node.children if c.tag == "distinct"):
                self._distinct([f"{name}.{x.strip()}" for x in d.attrs["of"].split(",")])
            return None
        columns = []
        for k, p in enumerate(parts):
            sub = f"{name}.{p.attrs['name']}" if "name" in p.attrs else f"{name}#{k}"
            columns.append(F.col(self._part(p, sub, f"{name}#{k}", domain).name))
        return self.put(name, self._only(domain, F.concat(*columns)))

    def _part(self, p: Node, name: str, stream: str, domain: Domain) -> Info:
        if p.tag == "data":
            return self.put(name, self._only(domain, F.lit(p.attrs.get("value", p.text))))
        return self._plain(p, name, stream, domain)

    def _only(self, domain: Domain, c: Column) -> Column:
        return c if domain.cond is None else F.when(domain.cond, c)

    def _conditional(self, gens: list[Node], name: str, domain: Domain):
        branches, rest = [], None
        for k, g in enumerate(gens):
            inner = self._plain(g, f"{name}#if{k}", f"{name}#if{k}", domain)
            if "if" in g.attrs:
                branches.append((self.truth(g.attrs["if"]), F.col(inner.name)))
            else:
                rest = F.col(inner.name)
        return self.put(name, self._only(domain, relate.first_match(branches, rest)))

    def _body(self, node: Node, name: str, domain: Domain) -> Column:
        """What a case holds: a text, or generators over the case's own rows."""
        if len(node.children) == 1 and node.children[0].tag == "data" and not node.children[0].attrs:
            return self.template(node.children[0].text)
        if not node.children:
            return F.lit(node.text)
        self._sequence(Node("sequence", {"name": name}, node.children) if node.children[0].tag != "switch" else Node("switch", node.children[0].attrs | {"name": name}, node.children[0].children), domain)
        return F.col(self.info[name].name)

    def _mix(self, node: Node, name: str, domain: Domain):
        cases = [c for c in node.children if c.tag == "case"]
        parts = apportion.counts(domain.n, apportion.shares(node.attrs.get("percent"), len(cases)), self.seed, name)
        place = self.fresh()
        self.df = self.df.withColumn(place, self._only(domain, rng.slot(self.seed, name, domain.n, domain.rank)))
        case = self.fresh()
        self.df = self.df.withColumn(case, self._only(domain, apportion.which(F.col(place), parts)))
        out, first = None, 0
        for k, (c, size) in enumerate(zip(cases, parts)):
            cond = F.coalesce(F.col(case) == k, F.lit(False))
            if size:
                value = self._body(c, f"{name}#{k}", Domain(cond, F.col(place) - first, size))
                out = F.when(cond, value) if out is None else out.when(cond, value)
            first += size
        made = self.put(name, F.lit(None).cast("string") if out is None else out)
        if "flag" in node.attrs:
            odd = [k for k, c in enumerate(cases) if c.attrs.get("anomaly") == "true"]
            self.put(node.attrs["flag"], self._only(domain, F.when(F.col(case).isin(*odd) if odd else F.lit(False), "true").otherwise("false")), kind="bool")
        return made

    def _switch(self, node: Node, name: str, domain: Domain):
        on = self.cell(node.attrs["on"])
        keys_of = lambda c: [k.strip() for k in c.attrs["is"].split("|")]
        table: dict[str, Column] = {}
        for c in node.children:
            if c.tag == "map":
                for pair in re.split(r"[,\n]", c.text):
                    if pair.strip():
                        k, _, v = pair.partition(":")
                        table[k.strip()] = F.lit(v.strip())
        taken = list(table)
        for k, c in enumerate(x for x in node.children if x.tag == "case"):
            hit = relate.match_key(on).isin(*[str(int(x)) if x.lstrip("+-").isdigit() else x for x in keys_of(c)])
            table[c.attrs["is"]] = self._body(c, f"{name}#{k}", self._branch(c, hit, domain))
            taken += keys_of(c)
        default = next((c for c in node.children if c.tag == "default"), None)
        rest = None
        if default is not None:
            hit = ~relate.match_key(on).isin(*[str(int(x)) if x.lstrip("+-").isdigit() else x for x in taken]) if taken else F.lit(True)
            rest = self._body(default, f"{name}#default", self._branch(default, F.coalesce(hit, F.lit(True)), domain))
        return self.put(name, self._only(domain, relate.switch(on, table, rest)))

    def _branch(self, case: Node, hit: Column, domain: Domain) -> Domain:
        cond = F.coalesce(hit, F.lit(False)) if domain.cond is None else F.coalesce(hit & domain.cond, F.lit(False))
        needs = any(g.tag == "gen" and (g.attrs.get("type") in ("text", "advanced_regex") or "percent" in g.attrs) for g in case.children)
        return self._ranked(cond) if needs else Domain(cond, F.col(ID), self.count)

    # --- one generator ---

    def _plain(self, g: Node, name: str, stream: str, domain: Domain) -> Info:
        a = g.attrs
        if "repeat" in a:
            return self._list(g, name, stream, domain)
        c, known = self.draw(g, stream, domain, F.col(ID), domain.rank, domain.n)
        return self._finish(c, known, a, name, stream, domain)

    def _finish(self, c: Column, known: dict, a: dict[str, str], name: str, stream: str, domain: Domain) -> Info:
        """Anomaly, then missing, then mask, then case."""
        u, m = rng.uniform(self.seed, stream + "#anom", F.col(ID)), rng.uniform(self.seed, stream + "#miss", F.col(ID))
        if "anomaly" in a:
            before = self.fresh()
            self.df = self.df.withColumn(before, c)
            share = float(a["anomaly"])
            c = checks.anomaly(F.col(before), u, share, float(a.get("anomaly_factor", 10)))
            if "anomaly_flag" in a:
                flag = checks.anomaly_flag(F.col(before), u, share, m if "missing" in a else None, float(a.get("missing", 0)))
                self.put(a["anomaly_flag"], self._only(domain, F.when(F.coalesce(flag, F.lit(False)), "true").otherwise("false")), kind="bool")
        if "missing" in a:
            c = checks.missing(c, m, float(a["missing"]), a.get("missing_as", ""))
            known = known | {"kind": known.get("kind", "text") if not a.get("missing_as") else "text", "nullable": True}
        if "mask" in a:
            c, known = X.mask(c, a["mask"]), {"kind": "text"}
        if "case" in a:
            c, known = X.CASES[a["case"]](c), {"kind": "text"}
        stamp = known.pop("stamp_", None)
        split = known.pop("split_", None)
        if stamp is not None:
            known["stamp"] = self.fresh()
            self.df = self.df.withColumn(known["stamp"], self._only(domain, stamp))
        if split is not None and not {"anomaly", "missing", "mask", "case"} & a.keys():
            known["place"] = self.fresh()
            self.df = self.df.withColumn(known["place"], self._only(domain, split[0]))
            known["split"] = split[1]
        return self.put(name, self._only(domain, c), **known)

    def _list(self, g: Node, name: str, stream: str, domain: Domain) -> Info:
        a = dict(g.attrs)
        low, _, high = a.pop("repeat").partition("..")
        low, high = int(low), int(high or low)
        if not 0 <= low <= high <= STRIDE:
            raise ConfigError("E060", f"repeat goes from 0 to {STRIDE}")
        sep = a.pop("separator", ",")
        parts = apportion.counts(domain.n, apportion.shares(a.pop("lengths", None), high - low + 1), self.seed, stream + "#len")
        place = rng.slot(self.seed, stream + "#len", domain.n, domain.rank)
        size, first = self.fresh(), self.fresh()
        which = apportion.which(place, parts)
        self.df = self.df.withColumn(size, which + low)
        # where a row's elements begin among all elements: those of shorter lists, then of rows before it in its own run
        runs, slots, total, row0 = [], [], 0, 0
        for k, p in enumerate(parts):
            runs.append(row0)
            slots.append(total)
            row0 += p
            total += p * (low + k)
        at = lambda v: F.element_at(F.array(*[F.lit(x).cast("long") for x in v]), (F.col(size) - low + 1).cast("int"))
        self.df = self.df.withColumn(first, at(slots) + (place - at(runs)) * F.col(size))
        acc, distinct = a.pop("accumulate", None), a.pop("distinct", None) == "true"
        inner = Node("gen", a, [])
        if distinct and a.get("type") == "text":
            values = a["value"].split(",")
            items = checks.sample_list(values, apportion.shares(a.get("percent"), len(values)), F.col(size), F.col(ID), self.seed, stream)
            known = {"kind": "text"}
        else:
            known = {}

            def one(k):
                c, got = self.draw(inner, stream + "#e", domain, F.col(ID) * STRIDE + k, F.col(first) + k, total)
                known.update({x: y for x, y in got.items() if not x.endswith("_")})
                return c

            indexes = F.when(F.col(size) > 0, F.sequence(F.lit(0).cast("long"), F.col(size).cast("long") - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
            items = F.transform(indexes, lambda k: one(k).cast("string"))
            if distinct:
                tries = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(STRIDE * 2 - 1).cast("long")), lambda k: self.draw(inner, stream + "#e", domain, F.col(ID) * STRIDE * 4 + k, F.col(first), total)[0].cast("string"))
                got = F.slice(F.array_distinct(tries), F.lit(1), F.col(size).cast("int"))
                items = F.when(F.size(got) < F.col(size), F.raise_error(F.lit("too few different values for a list")).cast("array<string>")).otherwise(got)
        if acc:
            kind = f"decimal(38,{known.get('decimals') or 0})"
            items = F.transform(relate.list_running(F.transform(items, lambda x: x.cast(kind)), acc, kind), lambda x: x.cast("string"))
        col = self.fresh()
        self.df = self.df.withColumn(col, self._only(domain, items))
        return self.put(name, F.array_join(col, sep), items=col, most=high, **known)

    def draw(self, g: Node, stream: str, domain: Domain, row: Column, rank: Column, n: int) -> tuple[Column, dict]:
        kind = g.attrs["type"]
        return getattr(self, "gen_" + kind)(g.attrs, stream, domain, row, rank, n)

    def u(self, stream: str, row: Column, k: int = 0) -> Column:
        return rng.uniform(self.seed, stream, row, k)

    def _choice(self, pairs: list[tuple[str, float]], a, stream, row, rank, n, even: bool) -> tuple[Column, dict]:
        """One of listed values: in turn, evenly by row, or in exact shares."""
        values = [v for v, _ in pairs]
        if a.get("order") == "sequential":
            place = F.pmod(rank, F.lit(len(values)))
            if a.get("cycle") == "false":
                place = F.when(rank < len(values), rank).otherwise(F.raise_error(F.lit("the list is shorter than the run")).cast("long"))
            return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int")), {}
        if even:
            place = F.least(F.floor(self.u(stream, row) * len(values)), F.lit(len(values) - 1))
            return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int")), {}
        self._whole("an exact share")
        parts = apportion.counts(n, [w for _, w in pairs], self.seed, stream)
        slot = rng.slot(self.seed, stream, n, rank)
        split, first = {}, 0
        for v, p in zip(values, parts):
            split.setdefault(v, (first, p))
            first += p
        return apportion.pick(slot, parts, values), {"split_": (slot, split)} if len(set(values)) == len(values) else {}

    def gen_text(self, a, stream, domain, row, rank, n):
        values = a["value"].split(",")
        return self._choice(list(zip(values, apportion.shares(a.get("percent"), len(values)))), a, stream, row, rank, n, False)

    def _numbers(self, text: str) -> list[tuple[int, int]]:
        out = []
        for part in re.findall(r"\[?(-?\d+)(?:\.\.(-?\d+))?\]?", text):
            lo, hi = int(part[0]), int(part[1] or part[0])
            if hi < lo:
                raise ConfigError("E070", f"the range {part[0]}..{part[1]} ends before it begins")
            out.append((lo, hi))
        return out

    @staticmethod
    def _without(keep: list[tuple[int, int]], drop: list[tuple[int, int]]) -> list[tuple[int, int]]:
        merged: list[list[int]] = []
        for lo, hi in sorted(keep):
            if merged and lo <= merged[-1][1] + 1:
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        out = [tuple(x) for x in merged]
        for lo, hi in drop:
            out = [y for a, b in out for y in ((a, min(b, lo - 1)), (max(a, hi + 1), b)) if y[0] <= y[1]]
        return sorted(set(out))

    def gen_number(self, a, stream, domain, row, rank, n):
        if "distribution" in a:
            return self._distribution(a, stream, row)
        d = int(a.get("decimals", 0))
        if "length" in a and "value" not in a:
            lengths = [x for lo, hi in self._numbers(a["length"].replace("-", "..")) for x in range(lo, hi + 1)]
            digits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(lengths))), lambda k: F.substring(F.lit("0123456789"), (rng.uniform(self.seed, stream, row * 2048 + k, 1) * 10 + 1).cast("int"), F.lit(1))), "")
            if a.get("first_zero", "false") != "true":
                digits = F.concat(F.substring(F.lit("123456789"), (self.u(stream, row, 2) * 9 + 1).cast("int"), F.lit(1)), F.substring(digits, 2, max(lengths)))
            size = F.lit(lengths[0])
            if len(lengths) > 1:
                size = apportion.pick(rng.slot(self.seed, stream + "#l", n, rank), apportion.counts(n, apportion.shares(a.get("percent"), len(lengths)), self.seed, stream), lengths)
            return F.substring(digits, F.lit(1), size), {"kind": "text"}
        value = a.get("value", "0..9")
        if value == "bit":
            return F.when(self.u(stream, row) < 0.5, "0").otherwise("1"), {"kind": "int"}
        if d:
            lo, _, hi = value.partition("..")
            scale = 10**d
            low, high = round(float(lo) * scale), round(float(hi or lo) * scale)
            c = (rng.between(self.seed, stream, row, low, high) / F.lit(scale)).cast(f"decimal(38,{d})")
            return c.cast("string"), {"kind": "double", "decimals": d}
        if "include" in a or "exclude" in a or "[" in value:
            spans = self._without(self._numbers(value) + self._numbers(a.get("include", "")), self._numbers(a.get("exclude", "")))
            if not spans:
                raise ConfigError("E071", "no number is left to draw")
            sizes = [hi - lo + 1 for lo, hi in spans]
            k = rng.between(self.seed, stream, row, 0, sum(sizes) - 1)
            out, first = None, 0
            for (lo, _), size in zip(spans, sizes):
                v = k - first + lo
                out = F.when(k < first + size, v) if out is None else out.when(k < first + size, v)
                first += size
            return out.cast("string"), {"kind": "int"}
        (lo, hi), = self._numbers(value)
        c = rng.between(self.seed, stream, row, lo, hi).cast("string")
        raw = value.split("..")
        width = max(len(x.lstrip("-")) for x in raw)
        if any(len(x.lstrip("-")) > 1 and x.lstrip("-").startswith("0") for x in raw):
            return X.pad_left(c, width, "0"), {"kind": "text"}
        return c, {"kind": "int"}

    def _parameter(self, text: str):
        try:
            return float(text)
        except ValueError:
            v = expr.Lowering(self.look)(expr.parse(text))
            return F.when(v.text != "", v.num)

    def _distribution(self, a, stream, row):
        p = lambda k, d: self._parameter(a.get(k, d))
        u, w, kind = self.u(stream, row, 1), self.u(stream, row, 2), a["distribution"]
        c = {
            "normal": lambda: shapes.normal(u, w, p("mean", "0"), p("sd", "1")), "lognormal": lambda: shapes.lognormal(u, w, p("meanlog", "0"), p("sdlog", "1")),
            "exponential": lambda: shapes.exponential(u, p("rate", "1")), "pareto": lambda: shapes.pareto(u, p("alpha", "1"), p("xmin", "1")), "weibull": lambda: shapes.weibull(u, p("shape", "1"), p("scale", "1")),
            "poisson": lambda: shapes.poisson(u, p("lambda", "1")), "zipf": lambda: shapes.zipf(u, int(p("n", "10")), p("s", "1")), "gamma": lambda: shapes.gamma(u, p("shape", "1"), p("scale", "1")), "beta": lambda: shapes.beta(u, p("alpha", "1"), p("beta", "1")),
        }
        if kind not in c:
            raise ConfigError("E072", f"no distribution is named {kind}")
        whole = kind in ("poisson", "zipf")
        return self._written(shapes.clipped(c[kind](), float(a["min"]) if "min" in a else None, float(a["max"]) if "max" in a else None), int(a.get("decimals", 0 if whole else 2)))

    def _written(self, c: Column, d: int) -> tuple[Column, dict]:
        return F.round(c.cast("double"), d).cast(f"decimal(38,{d})").cast("string"), {"kind": "double" if d else "int", "decimals": d}

    def _counter(self, a, rank, sign):
        start, step = a.get("value", "1"), a.get("step", "1")
        if start.lstrip("-").isdigit() and step.lstrip("-").isdigit():
            return (F.lit(int(start)) + sign * int(step) * rank).cast("string"), {"kind": "int"}
        d = max(len(x.partition(".")[2]) for x in (start, step))
        return (F.lit(start).cast(f"decimal(30,{d})") + F.lit(step).cast(f"decimal(20,{d})") * (rank * sign).cast("decimal(18,0)")).cast(f"decimal(38,{d})").cast("string"), {"kind": "double", "decimals": d}

    def gen_increment(self, a, stream, domain, row, rank, n):
        return self._counter(a, rank, 1)

    def gen_decrement(self, a, stream, domain, row, rank, n):
        return self._counter(a, rank, -1)

    def gen_symbol(self, a, stream, domain, row, rank, n):
        chars = patterns.ALPHABETS[a["alphabet"]] if "alphabet" in a else patterns.char_class(a["value"].strip("[]"))
        chars = "".join(dict.fromkeys(chars + a.get("include", "")))
        chars = "".join(c for c in chars if c not in a.get("exclude", ""))
        size = int(a.get("length", 1))
        if not 1 <= size <= 1024 or not chars:
            raise ConfigError("E073", "a symbol needs characters and a length from 1 to 1024")
        one = lambda k: F.substring(F.lit(chars), F.least(rng.uniform(self.seed, stream, row * 2048 + k) * len(chars) + 1, F.lit(float(len(chars)))).cast("int"), F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), one), ""), {}

    def gen_regex(self, a, stream, domain, row, rank, n):
        return patterns.draw(a["value"], self.seed, stream, row, n, rank, int(self.root.attrs.get("regex_max_length", 1000))), {}

    gen_advanced_regex = gen_regex

    def gen_date(self, a, stream, domain, row, rank, n):
        shape = a.get("format", "YYYY-MM-DD")
        if "of" in a:
            i = self.info.get(a["of"])
            if i is None or not i.stamp:
                raise ConfigError("E041", f"{a['of']} is no date declared above")
            ts = dates.offset(F.col(i.stamp), a.get("plus", "0d"), self.u(stream, row))
        elif a.get("order") == "sequential":
            ts = dates.walked(self._instant(a.get("from") or a["range"].split("..")[0]), a.get("step", "1d"), rank, a.get("weekdays"))
        elif a.get("value") in ("today", "now"):
            ts = F.lit(self.now if a["value"] == "now" else datetime(self.now.year, self.now.month, self.now.day)).cast("timestamp")
        else:
            if "oldest" in a or "youngest" in a:
                low, high = dates.age_range(self.now, int(a.get("oldest", 100)), int(a.get("youngest", 0)))
            elif "range" in a:
                low, high = map(self._instant, a["range"].split(".."))
            else:
                low, high = self._instant(a.get("from", "1970-01-01")), self._instant(a["to"]) if "to" in a else self.now
            ts = dates.uniform_between(self.u(stream, row), low, high, a.get("precision", "day"))
        return dates.formatted(ts, shape, a.get("local", self.locale)), {"kind": "date" if shape == "YYYY-MM-DD" else "text", "stamp_": ts}

    def _instant(self, text: str) -> datetime:
        text = text.strip()
        return self.now if text == "now" else datetime(self.now.year, self.now.month, self.now.day) if text == "today" else dates.parse_instant(text)

    def gen_template(self, a, stream, domain, row, rank, n):
        value = a["value"]
        if value == "common.id.uuid":
            h = F.concat(F.lpad(F.lower(F.hex(rng.hashed(self.seed, stream, row, 1))), 16, "0"), F.lpad(F.lower(F.hex(rng.hashed(self.seed, stream, row, 2))), 16, "0"))
            s = lambda i, k: F.substring(h, i, k)
            variant = F.substring(F.lit("89ab"), (F.pmod(rng.hashed(self.seed, stream, row, 3), F.lit(4)) + 1).cast("int"), F.lit(1))
            return F.concat_ws("-", s(1, 8), s(9, 4), F.concat(F.lit("4"), s(14, 3)), F.concat(variant, s(18, 3)), s(21, 12)), {"kind": "uuid"}
        if value == "person.b_day":
            return self.gen_date(a | {"oldest": a.get("oldest", "80"), "youngest": a.get("youngest", "18")}, stream, domain, row, rank, n)
        if value == "date.range":
            return self.gen_date(a, stream, domain, row, rank, n)
        if m := self.slot_text.search(value):
            subject = self.cell(m[1])
            names = sorted(x for x in {*files.BUILT_IN, *self.packs.files} if re.fullmatch(re.escape(value[:m.start()]) + ".+" + re.escape(value[m.end():]), x))
            keys = {x[m.start():len(x) - len(value[m.end():])]: x for x in names}
            pick = lambda x: self._choice(self.packs.look(x), a, stream, row, rank, n, True)[0]
            return relate.switch(subject, {k: pick(x) for k, x in keys.items()}, F.raise_error(F.concat(F.lit("no pack for "), subject)).cast("string")), {}
        pairs = self.packs.look(value, a.get("local"))
        return self._choice(pairs, a, stream, row, rank, n, len({w for _, w in pairs}) == 1)

    def gen_file(self, a, stream, domain, row, rank, n):
        path = files.resolve(a["src"], self.base, self.roots)
        if "row" in a:
            # the first column on a key draws the row; the others read the same one
            df = files.csv(self.spark, path, a.get("delimiter", ","), a.get("header", "true") == "true")
            first = a["row"] not in self.links
            if first:
                rows = [r.asDict() for r in df.limit(files.LIMIT + 1).collect()]
                self.links[a["row"]] = (a["src"], rows if len(rows) <= files.LIMIT else None, len(rows) if len(rows) <= files.LIMIT else df.count())
            src, rows, size = self.links[a["row"]]
            if src != a["src"]:
                raise ConfigError("E051", f"the row {a['row']} is of {src}, not of {a['src']}")
            if "weight" in a and a["row"] not in self.shared:
                self._weighted_row(a, df, stream, domain, rank, n, first)
            weight, many, shared = self.shared.get(a["row"], (None, n, None))
            if a.get("weight", weight) != weight or many != n:
                raise ConfigError("E051", f"the row {a['row']} is drawn by {weight} over {many} rows; another weight or number of rows can't follow it")
            place = F.col(shared) if shared else F.least(F.floor(self.u("row:" + a["row"], row) * size), F.lit(size - 1))
            if rows is not None:
                return F.element_at(F.array(*[F.lit(r[a["column"]]) for r in rows]), (place + 1).cast("int")), {}
            # too many for a plan: a join on the row's number
            if stream.endswith("#e"):
                raise ConfigError("E053", f"a list can't draw rows of {src}, which has more than {files.LIMIT}")
            at, value, number = self.fresh(), self.fresh(), self.fresh()
            right = files.numbered(df, number).select(number, F.col(f"`{a['column']}`").alias(value))
            self.df = self.df.withColumn(at, place).join(right, F.col(at) == F.col(number), "left").drop(at, number)
            return F.col(value), {}
        pairs = files.csv_column(self.spark, path, a["column"], a.get("weight"), a.get("delimiter", ","), a.get("header", "true") == "true") if "column" in a else [(v, 1.0) for v in files.values(self.spark, path)]
        if a.get("read") == "quantile":
            numbers = [float(v) for v, _ in pairs]
            d = int(a.get("decimals", max(len(v.partition(".")[2]) for v, _ in pairs)))
            u = shapes.exact_u(rng.slot(self.seed, stream, n, rank), n) if a.get("sample") == "exact" else self.u(stream, row)
            return self._written(shapes.quantile(u, numbers), d)
        return self._choice(pairs, a, stream, row, rank, n, "weight" not in a)

    def _weighted_row(self, a, df, stream, domain, rank, n, first: bool):
        """The place of a linked row in exact shares of a weight column, kept as a column that all on the link read."""
        if not first:
            raise ConfigError("E051", f"the row {a['row']} is drawn already; its first column must have the weight")
        if stream.endswith("#e"):
            raise ConfigError("E053", "a list can't draw weighted rows")
        if a["weight"] == a["column"]:
            raise ConfigError("E051", f"the weight {a['weight']} is the column of values itself")
        self._whole("an exact share")
        number, stream = self.fresh(), "row:" + a["row"]
        cells = [F.col(f"`{a[k]}`").cast("string") for k in ("column", "weight")]
        table = files.numbered(df, number).select(number, *[c.alias(k) for c, k in zip(cells, "vw")]).where("trim(v) != ''").orderBy(number).collect()
        try:
            weights = [float(r.w) for r in table]
            if not all(0 <= w < float("inf") for w in weights):
                raise ValueError
        except (TypeError, ValueError) as e:
            raise ConfigError("E051", f"the weights {a['weight']} of {a['src']} must be numbers of 0 or more") from e
        if not any(weights):
            raise ConfigError("E051", f"no row of {a['src']} has a weight above 0")
        parts, ends = apportion.counts(n, weights, self.seed, stream), 0
        runs = []
        for r, size in zip(table, parts):
            if size:
                runs.append((ends, ends + size - 1, r[0]))
            ends += size
        # a row for each slot, so that any number of runs is looked up by a plain join
        at, slot, place = self.fresh(), self.fresh(), self.fresh()
        slots = self.spark.createDataFrame(runs, "lo long, hi long, r long").select(F.explode(F.sequence("lo", "hi")).alias(slot), F.col("r").alias(place))
        self.df = self.df.withColumn(at, self._only(domain, rng.slot(self.seed, stream, n, rank))).join(slots, F.col(at) == F.col(slot), "left").drop(at, slot)
        self.shared[a["row"]] = a["weight"], n, place

    def gen_timeseries(self, a, stream, domain, row, rank, n):
        f = lambda k: float(a[k]) if k in a else None
        z = shapes.normal(self.u(stream, row, 1), self.u(stream, row, 2))
        return self._written(shapes.timeseries(rank, f("base") or 0, f("trend") or 0, f("period"), f("amplitude") or 0, f("peak_at"), f("noise") or 0, z), int(a.get("decimals", 2)))

    def _points(self, a, key="points"):
        if key in a and not a[key].endswith((".svg", ".png")):
            return [tuple(float(v) for v in re.split(r"[,:]", p.strip())) for p in re.split(r"[;\s]+", a[key].strip())]
        path = files.resolve(a.get("src") or a[key], self.base, self.roots)
        if path.endswith(".png"):
            with open(path, "rb") as f:
                return files.png_points(f.read(), int(a.get("ink_threshold", 128)))
        with open(path, encoding="utf-8") as f:
            return files.svg_points(f.read())

    def gen_pattern(self, a, stream, domain, row, rank, n):
        low, high = (float(x) for x in a.get("y_range", "0..1").split(".."))
        u, d = self.u(stream, row), int(a.get("decimals", 2))
        t = rank / float(max(1, n - 1))
        if "upper" in a and "lower" in a:
            top, bottom = self._points(a, "upper"), self._points(a, "lower")
            ys = [y for _, y in top + bottom]
            fit = lambda p: [((x - p[0][0]) / ((p[-1][0] - p[0][0]) or 1), low + (high - low) * (y - min(ys)) / ((max(ys) - min(ys)) or 1)) for x, y in p]
            lo = shapes.curve(fit(bottom), t, a.get("interp", "linear"))
            return self._written(lo + u * (shapes.curve(fit(top), t, a.get("interp", "linear")) - lo), d)
        points = self._points(a)
        if a.get("mode") == "density":
            return self._written(shapes.density(u, points, low, high), d)
        c = shapes.curve(shapes.scaled(points, low, high), t, a.get("interp", "linear"))
        if "spread" in a:
            c = c + (2 * u - 1) * float(a["spread"])
        return self._written(c, d)

    def gen_running(self, a, stream, domain, row, rank, n):
        self._whole("a running value")
        i = self.info.get(a["of"])
        if i is None:
            raise ConfigError("E040", f"{a['of']} is not declared above")
        d = i.decimals or len(a.get("base", "").partition(".")[2])
        kind = f"decimal(38,{d})"
        v = F.when(F.trim(F.col(i.name)) != "", F.col(i.name).cast(kind))
        base = F.lit(a["base"]).cast(kind) if "base" in a else None
        out, op = self.fresh(), a.get("accumulate", "sum")
        if "reset" in a:
            self.df = prefix.running_reset(self.df, ID, v, self.info[a["reset"]].name, out, op, base, known=self.ids)
        else:
            self.df = prefix.running(self.df, ID, v, out, op, base, known=self.ids)
        return F.when(F.col(i.name).isNotNull(), F.coalesce(F.col(out).cast(kind).cast("string"), F.lit(""))), {"kind": i.kind, "decimals": d}

    def gen_stat(self, a, stream, domain, row, rank, n):
        self._whole("a statistic of a column")
        i, op, out = self.info.get(a["of"]), a["op"], self.fresh()
        if i is None:
            raise ConfigError("E040", f"{a['of']} is not declared above")
        exact = op in ("sum", "min", "max")
        d = int(a.get("decimals", (i.decimals or 0) if exact or op == "count" else 2))
        self.df = checks.with_stat(self.df, i.name, op, out, scale=(i.decimals or 0) if exact else None)
        c = F.col(out).cast("decimal(38,0)") if op == "count" else F.round(F.col(out), d).cast(f"decimal(38,{d})")
        return c.cast("string"), {"kind": "int" if op == "count" or (exact and not d) else "double", "decimals": 0 if op == "count" else d}

    def gen_formula(self, a, stream, domain, row, rank, n):
        tree = expr.parse(a["expr"])
        v = expr.Lowering(self.look)(tree)
        read_ = [self.look(x).text for x in expr.names(tree) if self.look(x) is not None]
        empty = None
        for c in read_:
            empty = (F.coalesce(c, F.lit("")) == "") if empty is None else empty | (F.coalesce(c, F.lit("")) == "")
        bad = F.coalesce(F.isnan(v.num) | (F.abs(v.num) == float("inf")), F.lit(False))
        none = F.raise_error(F.concat(F.lit("a formula came to no number: "), F.lit(a["expr"])))
        if "decimals" in a:
            c, known = self._written(F.when(bad, none.cast("double")).otherwise(v.num), int(a["decimals"]))
        else:
            c, known = F.when(bad, none.cast("string")).otherwise(v.text), {}
        return (c if empty is None else F.when(~empty, c).otherwise(F.lit(""))), known

    def gen_pool(self, a, stream, domain, row, rank, n):
        name = stream
        pool = self.pools.get(a["value"])
        if pool is None:
            raise ConfigError("E052", f"there is no pool {a['value']}")
        u, pre = self.u("pool-ref:" + stream, F.col(ID)), self.fresh() + "_"
        rename = {c: f"f{k}" for k, c in enumerate(pool.columns) if c != ID}
        small = pool.select(ID, *[F.col(f"`{c}`").alias(x) for c, x in rename.items()])
        condition = a.get("filter")
        if condition is None:
            self.df = relate.pool_pick(self.df, small, ID, u, pre)
        else:
            tree = expr.parse(condition)
            sides = tree[2:] if tree[0] == "bin" and tree[1] == "==" and tree[2][0] == tree[3][0] == "name" else None
            mine = theirs = None
            if sides:
                (x,), (y,) = sides[0][1:], sides[1][1:]
                theirs, mine = (x, y) if x in rename and y in self.info else (y, x) if y in rename and x in self.info else (None, None)
            if theirs:
                self.df = relate.pool_pick_equal(self.df, small, ID, self.info[mine].name, rename[theirs], u, pre)
            else:
                def allowed(m):
                    look = lambda w: expr.from_text(m[pre + rename[w]]) if w in rename else self.look(w)
                    return expr.truth(expr.Lowering(look)(tree))

                self.df = relate.pool_pick_where(self.df, small, ID, allowed, u, pre)
        for c, x in rename.items():
            self.put(f"{name}.{c}", self._only(domain, F.col(pre + x)))
        return F.col(pre + next(iter(rename.values()))), {}

    def gen_http(self, a, stream, domain, row, rank, n):
        out = self.fresh()
        inputs = [self.info[x.strip()].name for x in a.get("in", "").split(",") if x.strip()]
        self.df = files.post_column(self.df, a["src"], inputs, out, seed=self.seed, secret=os.environ.get(a["secret"]) if "secret" in a else None, timeout=float(a.get("timeout", 30)), on_error=a.get("on_error", "fail"))
        return F.col(out), {}

    # --- constraints ---

    def _uniq(self, parts: list[Node], name: str, domain: Domain):
        """Distinct combinations of listed values: digits of a permuted number, so equal shares hold as well as they can."""
        self._whole("uniqueness")
        for p in parts:
            if odd := p.attrs.keys() & {"missing", "anomaly", "mask", "case", "repeat"}:
                raise ConfigError("E083", f"uniqueness of {name} can't be promised together with {', '.join(sorted(odd))}")
            shares = apportion.shares(p.attrs["percent"], len(p.attrs.get("value", "").split(","))) if "percent" in p.attrs else [1]
            if len(set(shares)) > 1:
                raise ConfigError("E083", f"uniqueness of {name} can't be promised with uneven shares")
        if any(p.attrs.get("type") in ("increment", "decrement") for p in parts):
            # a counter differs on every row, so whatever stands beside it does too
            if len(parts) == 1 and "name" not in parts[0].attrs:
                return self._plain(parts[0], name, name, domain)
            columns = [F.col(self._part(p, f"{name}.{p.attrs['name']}" if "name" in p.attrs else f"{name}#{k}", f"{name}#{k}", domain).name) for k, p in enumerate(parts)]
            return None if all("name" in p.attrs for p in parts) else self.put(name, self._only(domain, F.concat(*columns)))
        lists = []
        for p in parts:
            a = p.attrs
            if a.get("type") == "text":
                lists.append(a["value"].split(","))
            elif a.get("type") == "number" and not int(a.get("decimals", 0)):
                (lo, hi), = self._numbers(a["value"])
                if len(parts) == 1:
                    if hi - lo + 1 < domain.n:
                        raise ConfigError("E080", f"{domain.n} different numbers are needed, {hi - lo + 1} exist")
                    return self.put(name, self._only(domain, (rng.slot(self.seed, name, hi - lo + 1, domain.rank) + lo).cast("string")), kind="int")
                lists.append((lo, hi))
            elif a.get("type") == "template":
                lists.append([v for v, _ in self.packs.look(a["value"], a.get("local"))])
            elif a.get("type") == "file":
                lists.append(files.values(self.spark, files.resolve(a["src"], self.base, self.roots)))
            else:
                raise ConfigError("E081", f"uniq can't be promised for {a.get('type')}")
        sizes = [x[1] - x[0] + 1 if isinstance(x, tuple) else len(x) for x in lists]
        try:
            space = checks.space_of(sizes, domain.n)
        except ValueError as e:
            raise ConfigError("E080", str(e)) from e
        # a column of its own, so that it is computed once a row and not once a field
        number, columns = self.fresh(), []
        self.df = self.df.withColumn(number, self._only(domain, rng.slot(self.seed, name, space, domain.rank)))
        for p, x, place in zip(parts, lists, checks.digits(F.col(number), sizes)):
            c = (place + x[0]).cast("string") if isinstance(x, tuple) else F.element_at(F.array(*[F.lit(v) for v in x]), (place + 1).cast("int"))
            if "name" in p.attrs:
                self.put(f"{name}.{p.attrs['name']}", self._only(domain, c))
            columns.append(c)
        return self.put(name, self._only(domain, F.concat(*columns))) if not all("name" in p.attrs for p in parts) else None

    def _distinct(self, names: list[str]):
        """Columns that must differ within a row: a repeated value is drawn anew."""
        nodes = {}
        for c in self.env.children:
            if c.tag == "sequence":
                for g in c.children:
                    if g.tag == "gen":
                        nodes[f"{c.attrs['name']}.{g.attrs['name']}" if "name" in g.attrs else c.attrs["name"]] = g
        draws, more = [], []
        for x in names:
            i = self.info[x]
            again = [self.draw(nodes[x], f"{x}#d{k}", self.everything(), F.col(ID), rng.slot(self.seed, f"{x}#r{k}", self.count, F.col(ID)), self.count)[0] for k in range(1, checks.APART)]
            draws.append([F.col(i.name), *again])
            # the later attempts read one permutation from a place that moves on
            rank = rng.slot(self.seed, f"{x}#r", self.count, F.col(ID))
            more.append(checks.later(lambda k: self.draw(nodes[x], f"{x}#d#e", self.everything(), F.col(ID) * checks.ATTEMPTS + k, F.pmod(rank + k, F.lit(self.count)), self.count)[0]))
        together = self.fresh()
        self.df = self.df.withColumn(together, checks.differing(draws, more))
        for k, x in enumerate(names):
            fresh = self.fresh()
            self.df = self.df.withColumn(fresh, F.get(together, k))
            self.info[x].name = fresh

    def _uniq_check(self, names: list[str]):
        """Combinations that must not repeat over the run; checked before anything is written."""
        self._whole("uniqueness")
        columns = [self.info[x].name for x in names]
        present = self.df.dropna(subset=columns)
        if checks.duplicates(present, columns).limit(1).count():
            raise ConfigError("E082", f"the combination of {', '.join(names)} repeats")

    def _assert(self, node: Node):
        self._whole("a check of the run")
        tree = expr.parse(node.attrs["that"])
        names = sorted(x for x in expr.names(tree) if x in self.info)
        df = self.df.select(*[F.col(self.info[x].name).alias(x.replace(".", "__")) for x in names])
        known = checks.constants(df, df.columns) if names else {}
        look = lambda w: expr.from_text(F.lit(known[w.replace(".", "__")])) if w.replace(".", "__") in known else None
        if not self.spark.range(1).select(expr.truth(expr.Lowering(look)(tree))).first()[0]:
            raise AssertionError(node.attrs.get("says", node.attrs["that"]))

    # --- results ---

    def template(self, text: str, rebind: dict[str, Column] | None = None) -> Column:
        """Literal text with cells and filters put in; a name that is none stays as it is."""
        parts, at = [], 0
        for m in self.slot_text.finditer(text):
            parts.append(F.lit(text[at:m.start()]))
            at = m.end()
            name, *filters = m[1].split("|")
            if rebind and name in rebind:
                c = rebind[name].cast("string")
            else:
                v = self.look(name.strip())
                if v is None:
                    parts.append(F.lit(m[0]))
                    continue
                c = F.coalesce(v.text, F.lit(""))
            for f in filters:
                k, _, arg = f.partition(":")
                c = X.filtered(c, k.strip(), arg)
            parts.append(c)
        parts.append(F.lit(text[at:]))
        return F.concat(*parts)

    def table(self, keep_id: bool = False) -> DataFrame:
        """All declared columns by their names, as text; NULL where a column does not exist for a row."""
        names = [n for n in self.info if "#" not in n]
        return self.df.select(*([ID] if keep_id else []), *[F.col(self.info[n].name).alias(n) for n in names])

    def rendered(self) -> DataFrame:
        """_id and text of each record, as the block lays it out."""
        return sinks.rendered(self)

    def typed(self) -> DataFrame:
        """The columns as their declared or known types."""
        return sinks.typed(self)

    def write(self, path: str, single: bool = False) -> None:
        """Parquet of checked types where the path ends in .parquet, else the block's text."""
        sinks.write_parquet(self, path) if path.endswith(".parquet") else sinks.write_text(self, path, single)
