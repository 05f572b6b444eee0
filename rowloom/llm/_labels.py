"""What the classifiers share: folds by checksum, a bounded sample of labelled texts, and calibration."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import keep

#: Tasks over a sample.
SLICES = 16


def fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; of a null id, of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(of))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled ids that may be learnt from, the first by hash of id, kept in the shared folder.

    A label of an id given twice counts as its largest; of several texts of an id the least is taken. A null text is empty.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(learn)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return keep(found.repartition(SLICES, "doc_id"), "sample")


def cell(of: int) -> Column:
    """A row's part of a sample, from 0 to of - 1, by another hash of its id than the one that picked it."""
    return F.pmod(F.xxhash64("doc_id", F.lit("cell")), F.lit(of)).cast("int").alias("cell")


class Isotonic:
    """Rising steps by pooling neighbours that fall; each step counts a row of the mean label besides its own."""

    def __init__(self, x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not len(x):
            self.x, self.p = np.zeros(1), np.full(1, 0.5)
            return
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            if blocks and blocks[-1][3] == a:
                blocks[-1][0] += b
                blocks[-1][1] += 1
            else:
                blocks.append([b, 1, a, a])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                top = blocks.pop()
                blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
        mean = float(y.mean())
        p = [(s + mean) / (n + 1) for s, n, _, _ in blocks]
        self.x = np.array([v for _, _, a, b in blocks for v in (a, b)])
        self.p = np.maximum.accumulate(np.repeat(p, 2))

    def __call__(self, x):
        return np.clip(np.interp(x, self.x, self.p), 0.0, 1.0)
