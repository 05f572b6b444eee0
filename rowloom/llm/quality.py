"""Quality by compression: two zstandard dictionaries, one of good and one of bad text.

A text that its dictionary knows compresses smaller. The statistic is the difference of the
two compressed sizes over the text's bytes; an isotonic fit turns it into a score.
Dictionaries and calibration are learnt from separate halves of a bounded sample of
labelled rows (SAMPLE), a dictionary from at most PIECES pieces of the whole texts of its
label, picked by hash, in one task; no text reaches the driver. Scoring is one scan without a shuffle; whole texts are
compressed, long ones as a stream of blocks.

Defined cases: null counts as empty, whose statistic is 0 and whose score is that of 0; a
label other than 0 or 1 is ignored; without labelled rows of both kinds every score is the
mean label, 0.5 if there are none. Repeated rows get equal scores, a row each; other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import Isotonic, cell, fold, sample

#: Labelled rows that are learnt from, at most.
SAMPLE = 6_000
#: Bytes of each dictionary.
SIZE = 112_640
PIECE = 2_000
#: Pieces that a dictionary is trained on, at most.
PIECES = 10_000
LEVEL = 3


class Model:
    def __init__(self, bad: bytes, good: bytes, mean: float):
        self.dictionaries = [bad, good]
        self.good = self.bad = None
        self.calibrate = Isotonic([], []) if mean is None else Isotonic([0.0], [mean])

    def __getstate__(self):
        return self.__dict__ | {"good": None, "bad": None}

    def _ready(self):
        if self.good is None:
            self.bad, self.good = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdCompressor(level=LEVEL) for d in self.dictionaries]

    def statistic(self, raw: bytes) -> float:
        self._ready()
        if not raw:
            return 0.0
        return (len(self.bad.compress(raw)) - len(self.good.compress(raw))) / len(raw)

    def __call__(self, texts) -> np.ndarray:
        return self.calibrate(np.array([self.statistic((t or "").encode()) for t in texts], float))


def dictionary(pieces: list[bytes]) -> bytes:
    """Trained on the pieces; where they are too few for training, their own bytes."""
    try:
        return zstandard.train_dictionary(SIZE, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-SIZE:]


def _pieces(batches):
    for batch in batches:
        for doc, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            raw = text.encode()
            for i in range(0, len(raw), PIECE * 256):
                part = [raw[j:j + PIECE] for j in range(i, min(len(raw), i + PIECE * 256), PIECE)]
                order = [hashlib.blake2b(b"%d %d" % (doc, i + PIECE * j), digest_size=8).digest() for j in range(len(part))]
                yield pa.RecordBatch.from_arrays([pa.array(order, pa.binary()), pa.array(part, pa.binary())], names=["order", "piece"])


def _train(batches):
    got = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    if got:
        yield pa.RecordBatch.from_arrays([pa.array([dictionary([piece for _, piece in sorted(got)])], pa.binary())], names=["dictionary"])


def fit(docs: DataFrame, labels: DataFrame, learn, limit: int = SAMPLE) -> Model:
    """Both dictionaries are trained in a task each; the driver gets these, and a number for each row of the other half."""
    rows = sample(docs, labels, "quality", learn, limit).select("doc_id", "text", "y", cell(2))
    found = []
    for k in (0, 1):
        pieces = rows.where((F.col("cell") == 0) & (F.col("y") == k)).select("doc_id", "text").mapInArrow(_pieces, "order binary, piece binary")
        got = pieces.orderBy("order", "piece").limit(PIECES).mapInArrow(_train, "dictionary binary").collect()
        found.append(bytes(got[0][0]) if got else b"")
    mean = rows.agg(F.avg("y")).first()[0]
    model = Model(*found, mean)
    if mean is None or mean in (0.0, 1.0):
        return model

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.statistic(t.encode()) for t in batch.column(1).to_pylist()], pa.float64()), batch.column(2)], names=["doc_id", "x", "y"])

    half = rows.where("cell = 1").select("doc_id", "text", "y").mapInArrow(measure, "doc_id long, x double, y int").collect()
    if half:
        half.sort(key=lambda r: r.doc_id)
        model.calibrate = Isotonic([r.x for r in half], [r.y for r in half])
    return model


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score (0 to 1) for each row."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(model(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held: int = 0, at: float = 0.3, limit: int = SAMPLE) -> DataFrame:
    model = fit(docs, labels, fold(folds) != held, limit)
    out = score(docs, model)
    return out.select("doc_id", (fold(folds) == held).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
