"""Enrichment with a deterministic stand-in for the external service."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.operators.enrichment import enrich, error_code, progress, split_dead_letters
from tamis.plans.registry import query
from tamis.session import materialize
from tamis.sources.tables import documents, marks


def stand_in(text: str, attempt: int) -> tuple[int, str]:
    """Behaves by the first digit of the text's MD5: five kinds of trouble, else an answer."""
    kind = hashlib.md5(text.encode()).hexdigest()[0]
    if kind == "0":
        return 500, "busy"
    if kind == "1" and attempt < 3:
        raise TimeoutError
    if kind == "2":
        return 200, json.dumps({"detail": "none"})
    if kind == "3":
        return 200, "<html>"
    if kind == "4":
        raise ConnectionError("reset")
    return 200, json.dumps({"translatedText": f"ru:{text}"})


def enriched(spark: SparkSession, folder: str, report: Callable[[dict], None] | None = None) -> DataFrame:
    """All documents through the service; labels meet the answers."""
    texts = documents(spark, folder).select("doc_id", F.lit(None).cast("int").alias("label"), "text")
    answered = enrich(texts, stand_in, "doc_id", "label", "text", pause=0.0, report=report).drop("label")
    return answered.join(marks(spark, folder), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


_ENRICHED = """
WITH rows AS (
  SELECT d.doc_id, CASE WHEN 1 - l.quality >= 1 THEN 1 ELSE 0 END AS label, d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL),
pieces AS (
  SELECT doc_id, label, k, substr(text, k * 4999 + 1, 4999) AS payload
  FROM (SELECT *, unnest(range(0, greatest((length(text) + 4998) // 4999, 1))) AS k FROM rows)),
kinds AS (
  SELECT *, CASE WHEN payload = '' THEN '' ELSE substr(md5(payload), 1, 1) END AS kind FROM pieces),
tries AS (
  SELECT doc_id, label, k,
         CASE kind WHEN '' THEN 'empty_text' WHEN '0' THEN 'http_500' WHEN '2' THEN 'no_translatedText_in_response'
              WHEN '3' THEN 'bad_json' WHEN '4' THEN 'client_error' ELSE '' END AS error,
         CASE WHEN kind = '' THEN 0 WHEN kind IN ('0', '1', '2', '3', '4') THEN 3 ELSE 1 END AS attempts,
         'ru:' || payload AS answer
  FROM kinds),
enriched AS (
  SELECT doc_id, label, coalesce(arg_min(error, k) FILTER (error <> ''), '') AS error, max(attempts)::INT AS attempts,
         string_agg(answer, '' ORDER BY k) AS answer
  FROM tries GROUP BY doc_id, label)"""


@query("enrich_retry", f"""{_ENRICHED}
SELECT doc_id, label, error, attempts, md5(CASE WHEN error = '' THEN answer ELSE '' END) AS translated_md5
FROM enriched""")
def enrich_retry(spark, folder):
    answers = materialize(enriched(spark, folder), "answers")
    return answers.select("doc_id", "label", error_code().alias("error"), "attempts",
                          F.md5("translated").alias("translated_md5"))


@query("enrich_dead_letter", f"{_ENRICHED} SELECT doc_id, label, error, attempts FROM enriched WHERE error <> ''")
def enrich_dead_letter(spark, folder):
    _, dead = split_dead_letters(enriched(spark, folder))
    return dead.select("doc_id", "label", error_code().alias("error"), "attempts")


@query("enrich_progress", f"""{_ENRICHED},
requests AS (SELECT DISTINCT p.payload, t.attempts, t.error FROM pieces p JOIN tries t USING (doc_id, k) WHERE t.attempts > 0)
SELECT (SELECT count(*) FROM enriched) AS processed, (SELECT count(*) FROM enriched WHERE error <> '') AS failed,
       (SELECT CAST(sum(attempts) AS BIGINT) FROM requests) AS requests_sent,
       (SELECT CAST(sum(CASE WHEN error = '' THEN attempts - 1 ELSE attempts END) AS BIGINT) FROM requests) AS requests_failed""")
def enrich_progress(spark, folder):
    """Rows of the result and requests as they were counted while the job ran."""
    reports: list[dict] = []
    written = materialize(enriched(spark, folder, reports.append), "answers")
    total = reports[-1] if reports else {"sent": 0, "failed": 0}
    return progress(written).select("processed", "failed", F.lit(total["sent"]).cast("long").alias("requests_sent"),
                                    F.lit(total["failed"]).cast("long").alias("requests_failed"))
