"""The thin queries of this subpackage, and their SQL where SQL can say the same."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, decontaminate, licenses, lz, minhash, ngrams, quality, substrings, toxicity, warc
from ._shared import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), least=0.8)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0, at=0.3)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.edits(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=8)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= 2).alias("contaminated"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), roll=4 << 20).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2, at=0.3)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scored(table(spark, sf_dir, "documents"), folds=10, held=0)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"), length=100)


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_license_scans, op3_quality_classifier, op4_document_fingerprints, op5_benchmark_decontamination, op6_warc, op7_byte_level_bpe, op8_toxicity, op9_lm_scoring, op10_suffix_array_dedup)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_license_scans": licenses.sql(0.8),
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(r) AS c FROM reach GROUP BY id) m ON m.id = d.doc_id""",
    "op6_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first < page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.d = p.d AND p.n >= 100""",
    "op5_benchmark_decontamination": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 8) AS k, unnest(list_transform(range(1, greatest(len(ws) - 8, 0) + 2), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM bw WHERE len(ws) > 0),
pos AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win))),
hit AS (SELECT doc_id, i, win.k, item_id FROM pos JOIN win ON pos.g = win.g AND pos.k = win.k),
hw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items, sha256(coalesce(hi.s, '')) AS items_sha256, coalesce(hi.n, 0) >= 2 AS contaminated
FROM dw LEFT JOIN hw ON hw.doc_id = dw.doc_id LEFT JOIN hi ON hi.doc_id = dw.doc_id""",
}
