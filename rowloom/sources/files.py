"""Files of values: lists, CSV columns, weights, packs, drawings, and a service that fills a column."""
from __future__ import annotations

import hashlib
import hmac
import os
import re
import struct
import urllib.request
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that a source may have; so many fit a plan and a broadcast.
LIMIT = 100_000


def resolve(src: str, base: str, roots: list[str]) -> str:
    """@data/x under the first root that has it; else beside the description, else under the roots, the last one given first."""
    if "://" in src or os.path.isabs(src):
        return src
    name = src.removeprefix("@data/")
    places = [os.path.join(r, name) for r in reversed(roots)]
    if not src.startswith("@data/"):
        places.insert(0, os.path.join(base, name))
    return next((p for p in places if os.path.exists(p)), places[0] if places else name)


def values(spark: SparkSession, path: str) -> list[str]:
    """Lines of a text file, in order, empty ones left out."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"{path} has more than {LIMIT} values")
    return [r.value.rstrip("\r") for r in rows]


def csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """RFC 4180: quotes doubled inside quotes, line breaks within."""
    return spark.read.csv(path, sep=delimiter, header=header, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, mode="FAILFAST")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with each row's number from 0, in the order it is read."""
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    sizes, first, total = dict(df.groupBy(part.alias("p")).count().collect()), {}, 0
    for p in sorted(sizes):
        first[p] = total
        total += sizes[p]
    starts = F.create_map(*[F.lit(x).cast("long") for pair in first.items() for x in pair])
    return df.withColumn(name, F.element_at(starts, part) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def csv_column(spark: SparkSession, path: str, column: str, weight: str | None = None, delimiter: str = ",", header: bool = True) -> list[tuple[str, float]]:
    """(value, weight) of a column by name or number from 1; a blank cell is refused, a weight of zero leaves out."""
    df = csv(spark, path, delimiter, header)
    at = lambda c: F.col("`" + (df.columns[int(c) - 1] if c.isdigit() and c not in df.columns else c) + "`")
    rows = df.select(at(column).alias("v"), (at(weight).cast("double") if weight else F.lit(1.0)).alias("w")).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"{path} has more than {LIMIT} rows")
    if any(r.v is None or not r.v.strip() for r in rows):
        raise ValueError(f"{path} has a blank cell in column {column}")
    return [(r.v, r.w) for r in rows if r.w and r.w > 0]


#: A few values of our own for each address; more come from folders.
BUILT_IN = {
    "person.male.firstName": "Adam Boris Carl David Erik Frank Georg Hugo Ivan Jakob".split(),
    "person.female.firstName": "Anna Berta Clara Dora Emma Frida Greta Hanna Ida Julia".split(),
    "person.lastName": "Abbott Becker Castro Dubois Evans Fischer Garcia Huber Ivanov Jansen".split(),
    "address.city": "Aston Bridgeport Cliffton Dunmore Eastvale Fairview Greenfield Hillcrest".split(),
    "company.department": "Accounting Engineering Legal Marketing Operations Sales".split(),
}
BUILT_IN["person.firstName"] = BUILT_IN["person.male.firstName"] + BUILT_IN["person.female.firstName"]


class Packs:
    """Values by dotted address: a file a/b/c.txt under a folder is a.b.c, one under a locale's folder comes first for it. Lines `value,count` are weighted."""

    def __init__(self, folders: list[str], locale: str = "en"):
        self.locale, self.files = locale, {}
        for folder in folders:
            for d, _, names in os.walk(folder):
                for n in names:
                    if n.endswith((".txt", ".csv")):
                        address = os.path.relpath(os.path.join(d, n), folder).rsplit(".", 1)[0].replace(os.sep, ".")
                        self.files[address] = os.path.join(d, n)

    def look(self, address: str, locale: str | None = None) -> list[tuple[str, float]]:
        for a in (f"{locale or self.locale}.{address}", address):
            if a in self.files:
                with open(self.files[a], encoding="utf-8") as f:
                    lines = [x.rstrip("\r\n") for x in f if x.strip()]
                if self.files[a].endswith(".csv"):
                    pairs = [x.rpartition(",") for x in lines]
                    return [(v, float(w)) for v, _, w in pairs if float(w) > 0]
                return [(x, 1.0) for x in lines]
        if address in BUILT_IN:
            return [(x, 1.0) for x in BUILT_IN[address]]
        raise ValueError(f"no pack has {address}")


_NUMBER = re.compile(r"[MmLlHhVvCcQqZz]|-?\d*\.?\d+(?:[eE][-+]?\d+)?")


def svg_points(text: str, steps: int = 16) -> list[tuple[float, float]]:
    """The first path or polyline as points, y upwards; curves are cut into short lines."""
    if m := re.search(r"<polyline[^>]*points=\"([^\"]+)\"", text):
        n = [float(x) for x in re.findall(r"-?\d*\.?\d+", m[1])]
        return [(x, -y) for x, y in zip(n[0::2], n[1::2])]
    m = re.search(r"<path[^>]*\bd=\"([^\"]+)\"", text)
    if not m:
        raise ValueError("the drawing has no path")
    out: list[tuple[float, float]] = []
    t, i, cmd, x, y = _NUMBER.findall(m[1]), 0, "", 0.0, 0.0

    def take(k):
        nonlocal i
        got = [float(v) for v in t[i:i + k]]
        i += k
        return got

    while i < len(t):
        if t[i].isalpha():
            cmd = t[i]
            i += 1
            if cmd in "Zz":
                continue
        rel, up = cmd.islower(), cmd.upper()
        if up in "ML":
            dx, dy = take(2)
            x, y = (x + dx, y + dy) if rel else (dx, dy)
            out.append((x, y))
            cmd = {"M": "L", "m": "l"}.get(cmd, cmd)
        elif up in "HV":
            (v,) = take(1)
            x, y = ((x + v if rel else v), y) if up == "H" else (x, (y + v if rel else v))
            out.append((x, y))
        else:
            v = take(6 if up == "C" else 4)
            p = [(x, y), *((a + x, b + y) if rel else (a, b) for a, b in zip(v[0::2], v[1::2]))]
            for k in range(1, steps + 1):
                s = k / steps
                q = p
                while len(q) > 1:
                    q = [(a[0] + (b[0] - a[0]) * s, a[1] + (b[1] - a[1]) * s) for a, b in zip(q, q[1:])]
                out.append(q[0])
            x, y = p[-1]
    return [(a, -b) for a, b in out]


def png_points(data: bytes, threshold: int = 128) -> list[tuple[float, float]]:
    """For each column with ink the mean height of its ink; 8-bit grey, RGB, or either with alpha, not interlaced."""
    at, width, height, kind, raw = 8, 0, 0, 0, b""
    while at < len(data):
        n, tag = struct.unpack(">I4s", data[at:at + 8])
        body = data[at + 8:at + 8 + n]
        if tag == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or lace or kind not in (0, 2, 4, 6):
                raise ValueError("only plain 8-bit grey and colour pictures are read")
        elif tag == b"IDAT":
            raw += body
        at += n + 12
    size = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    pixels, line, before = zlib.decompress(raw), width * size, bytearray(width * size)
    ink: dict[int, list[int]] = {}
    for row in range(height):
        mode, cur = pixels[row * (line + 1)], bytearray(pixels[row * (line + 1) + 1:(row + 1) * (line + 1)])
        for i in range(line):
            a = cur[i - size] if i >= size else 0
            b, c = before[i], before[i - size] if i >= size else 0
            p = a + b - c
            best = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            cur[i] = (cur[i] + (0, a, b, (a + b) // 2, best)[mode]) & 255
        for col in range(width):
            px = cur[col * size:(col + 1) * size]
            dark = sum(px[:3 if size > 2 else 1]) / (3 if size > 2 else 1) < threshold
            if (px[-1] >= threshold and dark) if kind in (4, 6) else dark:
                ink.setdefault(col, []).append(height - row)
        before = cur
    return [(float(x), sum(v) / len(v)) for x, v in sorted(ink.items())]


def post_column(df: DataFrame, url: str, inputs: list[str], name: str, *, seed: str = "", secret: str | None = None, timeout: float = 30.0, on_error: str = "fail") -> DataFrame:
    """A column from a service: each batch is posted, one line for a row, and as many lines must come back.

    Outside the repeatable part: what comes back is the service's affair. A task done again asks again.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            lines = ["\t".join("" if v is None else str(v) for v in row) for row in zip(*columns)] if inputs else [""] * batch.num_rows
            body = "\n".join(lines).encode()
            head = {"Content-Type": "text/plain; charset=utf-8", "X-Row-Count": str(batch.num_rows), "X-Seed": seed}
            if secret:
                head["X-Signature"] = hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=timeout) as r:
                    got = r.read().decode().split("\n")
                if got and got[-1] == "" and len(got) == batch.num_rows + 1:
                    got.pop()
                if len(got) != batch.num_rows:
                    raise ValueError(f"{batch.num_rows} rows were sent, {len(got)} lines came back")
            except Exception as e:
                if on_error == "fail" or getattr(e, "code", None) == 429:
                    raise
                got = [""] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
