"""Deterministic sharded WARC archives: written in order of page id, rolled by compressed size, and read back.

Digests are taken in one scan; of records with equal payloads of at least `least` bytes the
smallest id is the response and the others revisit it. Pages are cut into ranges of id by
exact bounds, shuffled once and sorted; the few notes on revisits travel with them. Each
range writes its files, a gzip member for each record, under temporary names and renames
each when it is complete; the manifest, written last by Spark's own committer, names the
files, their records, sizes and hashes. The same pages give the same bytes; a task done again writes the
same files again. Reading follows the manifest alone and checks every digest.

The folder may be of any file system that pyarrow opens; all machines must reach it.

Defined cases: null html is an empty payload; a null id comes first, is never referred to and
reads back as null; rows that repeat an id with the same payload are all responses if that id is
the smallest of its payload, else all revisits; a null url is left out of the header. Other columns are ignored.
"""
from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._order import run_of, upper_bounds
from ._shared import cut, new_folder

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "run int, file string, records long, size long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(folder: str):
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A record, headers and digests made anew, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n", 6, mtime=0)


class _Files:
    """The files of one range; each is renamed when it is complete."""

    def __init__(self, folder: str, run: int, roll: int):
        self.fs, self.path = _open(folder)
        self.run, self.roll, self.done, self.out = run, roll, [], None
        self.temporary = f"{self.path}/_temporary/{run:06d}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.temporary, recursive=True)

    def add(self, member: bytes):
        if self.out is not None and self.size + len(member) > self.roll:
            self.close()
        if self.out is None:
            self.name = f"part-{self.run:06d}-{len(self.done):05d}.warc.gz"
            self.out, self.size, self.records, self.hash = self.fs.open_output_stream(f"{self.temporary}/{self.name}"), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)
        self.records += 1

    def close(self):
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.temporary}/{self.name}", f"{self.path}/{self.name}")
            self.done.append((self.run, self.name, self.records, self.size, self.hash.hexdigest()))
            self.out = None

    def finish(self):
        self.close()
        self.fs.delete_dir(self.temporary)
        return self.done


def _deal(bounds: list[int]):
    upper = np.array(bounds, np.int64)

    def run(batches):
        for batch in batches:
            keys = batch.column(0).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            at = run_of(keys, upper) if len(upper) else np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["run", *batch.schema.names])

    return run


def write(pages: DataFrame, folder: str, *, roll: int = 1 << 30, run_bytes: int | None = None, least: int = 100, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes pages(page_id, url, html) and gives the manifest. roll: compressed bytes of a file; a larger record has a file to itself."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    known = cut(pages.select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.octet_length("html").cast("long").alias("n")))
    first = known.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("m")).where("m > 1 and first is not null")
    notes = known.where(F.col("n") >= least).join(first.select("digest", "first"), "digest").where("page_id is null or page_id > first")
    total = known.agg(F.sum("n")).first()[0] or 0
    size = run_bytes or max(32 << 20, total // 50_000)
    bounds = upper_bounds(known, "page_id", F.col("n") + 500, max(1, -(-total // size)))
    rows = pages.select("page_id", "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("first"))
    rows = rows.unionByName(notes.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first"))
    dealt = rows.mapInArrow(_deal(bounds), "run int, page_id long, url string, html string, digest string, first long")
    dealt = dealt.repartitionById(max(1, len(bounds)), F.col("run")).sortWithinPartitions("run", "page_id", F.col("digest").isNull(), "url", "html")

    def put(batches):
        files, key, refers = None, None, {}
        made = []
        for batch in batches:
            for row in batch.to_pylist():
                if files is None or files.run != row["run"]:
                    made += files.finish() if files else []
                    files = _Files(folder, row["run"], roll)
                if (row["run"], row["page_id"]) != key:
                    key, refers = (row["run"], row["page_id"]), {}
                if row["digest"] is not None:
                    refers[row["digest"]] = row["first"]
                    continue
                payload = row["html"].encode()
                digest = hashlib.sha256(payload).hexdigest()
                files.add(record(row["page_id"], row["url"], payload, digest, refers.get(digest) if len(payload) >= least else None, date))
        made += files.finish() if files else []
        if made:
            columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "file", "records", "size", "sha256"])

    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    dealt.mapInArrow(put, MANIFEST).write.json(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def records_of(stream):
    """(headers, block) of each record of a file of gzip members."""
    with gzip.GzipFile(fileobj=stream) as f:
        reader = io.BufferedReader(f, 1 << 20)
        while line := reader.readline():
            if line.strip() == b"":
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = {}
            while (line := reader.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.strip()] = v.strip()
            yield head, reader.read(int(head["Content-Length"]))


def read(spark, folder: str) -> DataFrame:
    """A row for each record in the files that the manifest names, digests checked."""
    files = manifest(spark, folder).select("file", "records")
    n = max(1, files.count())
    files = files.repartition(min(n, 20_000), "file")

    def get(batches):
        fs, path = _open(folder)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(f"{path}/{name}") as stream:
                    for head, block in records_of(stream):
                        seen += 1
                        if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
                            raise ValueError(f"{name}: a block's digest is wrong")
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
                                raise ValueError(f"{name}: a payload's digest is wrong")
                        whole = lambda k, head=head: int(head[k]) if k in head else None
                        rows.append((whole("X-Page-Id"), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], whole("X-Refers-To-Page")))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                if seen != expected:
                    raise ValueError(f"{name} has {seen} records, the manifest {expected}")
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(get, RECORD)


def _batch(rows):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def round_trip(pages: DataFrame, folder: str | None = None, **how) -> DataFrame:
    """Writes an archive (in the shared folder unless told) and reads it back."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write(pages, folder, **how)
    return read(spark, folder)
