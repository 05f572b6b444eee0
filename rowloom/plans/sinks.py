"""What a run is written as: records of text laid out by blocks and lines, and Parquet of checked types.

Both are columns over the run's rows, so every partition renders or casts its own rows. Text is
written as one row a record; the files keep the order of rows, and a single file is made of
them by the driver as bytes, without collecting rows.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compute import Node
from .config import ConfigError

FIXTURES = ("before", "after", "before_block", "after_block", "delimiter_block", "before_line", "after_line", "delimiter_line")


# --- text ---


def _data(run, node: Node, rebind=None) -> Column:
    """The texts of a line's <data>, those left out whose condition does not hold."""
    parts = []
    for d in node.children:
        c = run.template(d.text, rebind)
        parts.append(F.when(run.truth(d.attrs["if"]), c).otherwise(F.lit("")) if "if" in d.attrs else c)
    return F.concat(*parts) if parts else run.template(node.text, rebind)


def _lanes(run) -> tuple[dict[str, int], int]:
    """Of each list the place of its keys within a record's, and how many keys a record has."""
    lanes, stride = {}, 0
    for name, i in run.info.items():
        if i.items and "#" not in name:
            lanes[name] = stride
            stride += i.most
    return lanes, stride


def _plain(run, node: Node) -> Column:
    """The text of a <line> without each=, with its line break; empty where its condition does not hold."""
    c = F.concat(_data(run, node), F.lit("\n"))
    return F.when(run.truth(node.attrs["if"]), c).otherwise("") if "if" in node.attrs else c


def _line(run, node: Node) -> Column:
    """The output lines of a <line>, as an array: none where its condition does not hold, one for each element with each=."""
    name = node.attrs.get("each", "").strip()
    if not name:
        made = F.array(F.concat(_data(run, node), F.lit("\n")))
    else:
        i = run.info.get(name)
        if i is None or not i.items:
            raise ConfigError("E042", f"each={name!r} is no list declared above")
        lanes, stride = _lanes(run)

        def one(x, k):
            key = F.col("_id") * F.lit(stride).cast("long") + F.lit(lanes[name] + 1) + k
            return F.concat(_data(run, node, {name: x, "_item": (k + 1).cast("string"), "_item_id": key.cast("string")}), F.lit("\n"))

        made = F.transform(F.coalesce(F.col(i.items), F.expr("cast(array() as array<string>)")), one)
    none = F.expr("cast(array() as array<string>)")
    return F.when(run.truth(node.attrs["if"]), made).otherwise(none) if "if" in node.attrs else made


def _fixed(run, tag: str) -> Column:
    """The lines of a fixture, interpolated with the row's values."""
    nodes = [c for c in run.env.children if c.tag == tag]
    lines = [x for n in nodes for x in ([c for c in n.children if c.tag == "line"] or [n])]
    return F.concat(*[_plain(run, x) for x in lines]) if lines else F.lit("")


def _block(run) -> list[Node]:
    block = next((c for c in run.root.children if c.tag == "block"), None)
    if block is None:
        raise ConfigError("E043", "there is no <block> to lay out")
    return [x for x in block.children if x.tag == "line"]


def record(run) -> Column:
    """The whole text of a row: delimiters stand between the lines and records that are left, the header before the first, the footer after the last."""
    nodes, has = _block(run), {c.tag for c in run.env.children}
    if not nodes:
        body = F.lit("")
    elif has & {"before_line", "after_line", "delimiter_line"}:
        before, after, between = (_fixed(run, t) for t in ("before_line", "after_line", "delimiter_line"))
        body = F.array_join(F.transform(F.concat(*[_line(run, x) for x in nodes]), lambda x: F.concat(before, x, after)), "\0")
        body = F.replace(body, F.lit("\0"), between)
    else:
        body = F.concat(*[F.array_join(_line(run, x), "") if "each" in x.attrs else _plain(run, x) for x in nodes])
    first, last = F.col("_id") == 0, F.col("_id") == run.count - 1
    parts = [body]
    if "before_block" in has:
        parts.insert(0, _fixed(run, "before_block"))
    if "before" in has:
        parts.insert(0, F.when(first, _fixed(run, "before")).otherwise(""))
    if "after_block" in has:
        parts.append(_fixed(run, "after_block"))
    if "delimiter_block" in has:
        parts.append(F.when(last, "").otherwise(_fixed(run, "delimiter_block")))
    if "after" in has:
        parts.append(F.when(last, _fixed(run, "after")).otherwise(""))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def rendered(run) -> DataFrame:
    """_id and text of each row."""
    return run.df.select("_id", record(run).alias("text"))


def write_text(run, path: str, single: bool = False) -> None:
    """The rendered run as text files in the order of rows, or as one file."""
    out = rendered(run)
    if re.search(r"(?<!Broadcast)Exchange", out._jdf.queryExecution().executedPlan().toString()):
        out = out.repartitionByRange("_id").sortWithinPartitions("_id")
    if all(x.attrs.keys() & {"if", "each"} for x in _block(run)):  # a record may have no line; explode, so that texts are made once
        out = out.select(F.explode(F.expr("if(text <> '', array(text), null)")).alias("text"))
    # a record ends with a line break, which the writer adds
    folder = path + ".parts" if single else path
    out.select(F.expr("substring(text, 1, length(text) - 1)").alias("value")).write.mode("overwrite").text(folder)
    if single:
        _joined(run.spark, folder, path)


def _joined(spark, folder: str, path: str) -> None:
    """The parts of a folder one after the other in a file, under a temporary name until it is whole; the folder goes."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(folder).getFileSystem(conf)
    temporary = at(path + ".tmp")
    sink = fs.create(temporary, True)
    try:
        for p in sorted(s.getPath().toString() for s in fs.listStatus(at(folder)) if s.getPath().getName().startswith("part-")):
            source = fs.open(at(p))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, sink, conf, False)
            finally:
                source.close()
    finally:
        sink.close()
    fs.delete(at(path), False)
    fs.rename(temporary, at(path))
    fs.delete(at(folder), True)


# --- types ---

_WHOLE = {"int32": (-(2**31), 2**31 - 1, "int"), "int64": (-(2**63), 2**63 - 1, "bigint"), "uint8": (0, 2**8 - 1, "smallint"), "uint16": (0, 2**16 - 1, "int"), "uint32": (0, 2**32 - 1, "bigint"), "uint64": (0, 2**64 - 1, "decimal(20,0)")}
_PLAIN = {"bool": "boolean", "float": "float", "float16": "float", "double": "double", "string": "string", "enum": "string", "json": "string", "uuid": "string", "date": "date", "timestamp": "timestamp"}


@dataclass(frozen=True)
class Type:
    kind: str
    nullable: bool = False
    precision: int = 0
    scale: int = 0
    items: bool = False

    @property
    def spark(self) -> str:
        if self.kind == "decimal":
            return f"decimal({self.precision},{self.scale})"
        return _WHOLE[self.kind][2] if self.kind in _WHOLE else _PLAIN[self.kind]


def parse_type(text: str) -> Type:
    """`[]` before a type makes a list of it, `|null` after it lets it (or its elements) be null."""
    m = re.fullmatch(r"\s*(\[\])?\s*([A-Za-z]\w*)\s*(?:\(\s*(\d+)\s*,\s*(\d+)\s*\))?\s*(\|\s*null)?\s*", text)
    if not m or m[2] not in {*_WHOLE, *_PLAIN, "decimal"} or (m[2] == "decimal") != (m[3] is not None):
        raise ConfigError("E075", f"no type is written {text!r}")
    p, s = int(m[3] or 0), int(m[4] or 0)
    if m[2] == "decimal" and not (1 <= p <= 18 and s <= p):
        raise ConfigError("E075", f"a decimal has a precision from 1 to 18 and a scale up to it, not {text!r}")
    return Type(m[2], bool(m[5]), p, s, bool(m[1]))


def checked(c: Column, t: Type, name: str) -> Column:
    """The text as the type; what the type can't hold whole stops the run: nothing is rounded, cut or made null."""
    text = F.trim(c)

    def stop(why: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{name}: "), F.coalesce(F.concat(F.lit('"'), c, F.lit('" ')), F.lit("")), F.lit(why)))

    def only(ok: Column, value: Column, why: str) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(stop(why).cast(t.spark))

    if t.kind in ("string", "enum", "json"):
        made = c
    elif t.kind == "bool":
        low = F.lower(text)
        made = only(low.isin("true", "1", "false", "0"), low.isin("true", "1"), "is not a boolean")
    elif t.kind in _WHOLE:
        low, high, _ = _WHOLE[t.kind]
        n = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("decimal(38,0)"))
        made = only(n.between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")), n.cast(t.spark), f"does not fit {t.kind}")
    elif t.kind in ("double", "float", "float16"):
        n = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
        v = n
        if t.kind == "float16":  # eleven bits of a number, the smallest step being 2^-24
            step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(n))), F.lit(-14)) - 10)
            v = F.when(n == 0, n).otherwise(F.rint(n / step) * step)
            v = F.when(F.abs(v) < 65520, v)
        v = v.cast(t.spark)
        made = only(F.abs(v) < float("inf"), v, f"does not fit {t.kind}")
    elif t.kind == "date":
        d = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        made = only(d.isNotNull(), d, "is not a date")
    elif t.kind == "timestamp":
        shape = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
        part = lambda k: F.regexp_extract(text, shape, k)
        zone = F.when(part(5) == "", "Z").otherwise(F.regexp_replace(part(5), r"^([+-]\d\d):?(\d\d)$", "$1:$2"))
        whole = F.concat(part(1), F.lit("T"), part(2), F.when(part(3) == "", ":00").otherwise(part(3)), F.substring(part(4), 1, 4), zone)
        whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(shape), whole)
        d = whole.try_cast("timestamp")
        made = only(d.isNotNull(), d, "is not a timestamp")
    elif t.kind == "decimal":
        fraction = F.length(F.regexp_extract(text, r"^[+-]?\d+\.(\d+)$", 1))
        digits = F.length(F.regexp_replace(F.regexp_extract(text, r"^[+-]?(\d+)", 1), "^0+", ""))
        ok = text.rlike(r"^[+-]?\d+(\.\d+)?$") & (fraction <= t.scale) & (digits <= t.precision - t.scale)
        made = only(ok, F.when(ok, text).cast(t.spark), f"does not fit decimal({t.precision},{t.scale})")
    else:
        h = F.lower(F.replace(text, F.lit("-"), F.lit("")))
        made = only(h.rlike("^[0-9a-f]{32}$"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), "is not a uuid")
    empty = F.coalesce(c, F.lit("")) == ""
    return F.when(~empty, made).otherwise(F.lit(None) if t.nullable else stop("empty value in a required column").cast(t.spark))


def derived(run, name: str) -> Type:
    """What a declared column is known to hold; text where that is not known."""
    i = run.info[name]
    kind = {"int": "int64", "double": "double", "bool": "bool", "date": "date", "uuid": "uuid"}.get(i.kind, "string")
    return Type(kind, i.nullable, items=bool(i.items))


def _each(t: Type, name: str):
    return lambda x: checked(x, t, name)


def _columns(run) -> list[tuple[str, Column, Type]]:
    """The named <data> of the block; without a block, all declared columns."""
    block = next((c for c in run.root.children if c.tag == "block"), None)
    if block is None:
        named = [(n, n, None) for n in run.info if "#" not in n]
    else:
        named = []
        for d in (d for line in block.children for d in line.children if d.attrs.get("name", "").strip()):
            m = run.slot_text.fullmatch(d.text.strip())
            source = m[1].strip() if m and m[1].strip() in run.info else None
            named.append((d.attrs["name"].strip(), source, d))
        if not named:
            raise ConfigError("E076", "typed output needs a <data> with a name in the <block>")
    names = [n for n, _, _ in named]
    if twice := next((n for n in names if names.count(n) > 1), None):
        raise ConfigError("E076", f"two columns are named {twice}")
    out = []
    for name, source, d in named:
        t = parse_type(d.attrs["type"]) if d is not None and "type" in d.attrs else derived(run, source) if source else Type("string")
        text = F.col(run.info[source].name) if source else run.template(d.text)
        if t.items:
            i = run.info.get(source) if source else None
            items = F.col(i.items) if i and i.items else F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, ",", -1))
            c = F.transform(F.coalesce(items, F.expr("cast(array() as array<string>)")), _each(t, name))
        else:
            absent = run.info[source].absent if source else False
            c = checked(text, t if not absent else Type(t.kind, True, t.precision, t.scale), name)
        out.append((name, c, t))
    return out


def typed(run) -> DataFrame:
    """The run's columns as their types."""
    return run.df.select(*[c.alias(n) for n, c, _ in _columns(run)])


def write_parquet(run, path: str) -> None:
    """The typed columns as Parquet, in the order of rows within and across files where nothing was shuffled; else sorted by row."""
    out = run.df.select("_id", *[c.alias(n) for n, c, _ in _columns(run)])
    if re.search(r"(?<!Broadcast)Exchange", out._jdf.queryExecution().executedPlan().toString()):
        out = out.repartitionByRange("_id").sortWithinPartitions("_id")
    out.drop("_id").write.mode("overwrite").option("compression", "snappy").parquet(path)
