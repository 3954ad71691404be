"""Registered queries of the cleaning, scanning, coding, language and archive operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracle, quality
from .archives import archive_round_trip
from .language import evidence_of, fit_text, identify
from .lexicon import round_trip
from .licenses import scan_licenses
from .quality import judge
from .session import table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learned = documents.filter("crc32(cast(doc_id AS string)) % 3 <> 1")  # the others are held out, to measure with
    return identify(evidence_of(documents, table(spark, sf_dir, "pages")), fit_text(learned))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> winner THEN winner END AS refers_to
FROM w
"""

QUERIES = {
    "op2_quality_rules": op2_quality_rules,
    "op5_license_scans": op5_license_scans,
    "op7_bpe_lexicon": op7_bpe_lexicon,
    "op8_language_id": op8_language_id,
    "op10_warc": op10_warc,
}
ORACLES = {"op2_quality_rules": quality.ORACLE_SQL, "op5_license_scans": oracle.LICENSES, "op10_warc": OP10_SQL}
