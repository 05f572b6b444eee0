"""The corpus pipeline: toxicity, near-duplicates, long repeats, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Between stages the rows are written as Parquet to the shared folder
and read again, so a stage that loses its executors begins from a table.

Defined cases: null and empty texts are never toxic beyond the score of an empty text, copies of
nothing, and pass unchanged; rows that repeat id and text stay once, those of one id with several
texts all stay; null ids stay; empty tables give empty results; other columns are kept as they are.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import bpe, decontaminate, minhash, substrings, toxicity
from rowloom.llm._labels import fold
from rowloom.llm._shared import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3; the model is learnt from the labelled rows of `documents` whose checksum modulo 4 isn't 2."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(4) != 2)
    return toxicity.reject(docs, model, at=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike by 0.8 in five-word shingles, the one with the smallest id."""
    return minhash.keep_one(docs, shingle=5, percent=80)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier, by whole characters."""
    return substrings.remove(docs, length=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold windows of two benchmark items; from the others the spans hit are taken out."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), width=8, drop_from=2)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their tokens, and whether these decode to the very text."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("long repeats", drop_repeats),
    ("decontamination", drop_benchmark),
    ("tokens", to_tokens),
]

#: SQL can express neither the trees nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
