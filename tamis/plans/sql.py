"""DuckDB building blocks shared by the oracle queries."""

from __future__ import annotations

import os
import string
import zipfile
from functools import cache
from pathlib import Path

import pyspark

from tamis.functions.text import JAVA_SPACE, PYTHON_SPACE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def stop_words(language: str) -> tuple[str, ...]:
    """Spark's word list, read from its jar so that no session is needed."""
    home = Path(os.environ.get("SPARK_HOME") or Path(pyspark.__file__).parent)
    jar = next((home / "jars").glob("spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as archive:
        raw = archive.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt")
    return tuple(dict.fromkeys(word.lower() for word in raw.decode().splitlines()))


def word_list(language: str) -> str:
    return ", ".join(quoted(word) for word in stop_words(language))


SPACE = quoted(JAVA_SPACE)
ANY_SPACE = quoted(PYTHON_SPACE)
PUNCTUATION = quoted(string.punctuation)
NOT_STOP = f"word NOT IN ({word_list('english')})"


def tokens(text: str) -> str:
    body = f"rtrim(lower({text}), {SPACE})"
    return (
        f"CASE WHEN {body} = '' AND {text} <> '' THEN CAST([] AS VARCHAR[]) "
        rf"ELSE string_split_regex({body}, '[ \t\n\x0B\f\r]') END"
    )


def bag(text: str) -> str:
    return (
        f"list_filter(string_split_regex(translate(lower({text}), {PUNCTUATION}, ''), "
        f"'[' || {ANY_SPACE} || ']+'), lambda w: length(w) > 2)"
    )


def in_share(key: str = "doc_id") -> str:
    return f"substr(md5(CAST({key} AS VARCHAR)), 1, 8) < 'b3333333'"


REPAIR = "CASE WHEN {0} IS NULL THEN 0 WHEN {0} >= 1 THEN 1 ELSE 0 END"

LABELLED = f"""labelled AS (
  SELECT d.doc_id, d.lang, d.text, {REPAIR.format('(1 - l.quality)')} AS label,
         {in_share('d.doc_id')} AS is_train
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL)"""

# Messages that may be missing: the reply that follows each turn of a conversation.
REPLIES = """replies AS (
  SELECT c.conv_id, c.turn, n.text AS reply
  FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)"""


def naive_bayes(scored: str, vocab_size: int = 500_000, min_df: int = 5) -> str:
    """CTEs ``theta(term, n0, n1, theta0, theta1)``, ``priors`` and ``nb(doc_id, ...)``.

    ``scored`` is a select of ``doc_id, text`` for the documents to score.
    """
    return f"""{LABELLED},
train_words AS (
  SELECT doc_id, label, unnest({tokens('text')}) AS word FROM labelled WHERE is_train),
train_terms AS (
  SELECT doc_id, label, word AS term, count(*) AS n FROM train_words WHERE {NOT_STOP} GROUP BY ALL),
vocabulary AS (
  SELECT term, CAST(sum(n) AS BIGINT) AS tf,
         CAST(sum(CASE WHEN label = 0 THEN n ELSE 0 END) AS BIGINT) AS n0,
         CAST(sum(CASE WHEN label = 1 THEN n ELSE 0 END) AS BIGINT) AS n1
  FROM train_terms GROUP BY term HAVING count(*) >= {min_df}
  ORDER BY tf DESC, term LIMIT {vocab_size}),
totals AS (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM vocabulary),
theta AS (
  SELECT term, n0, n1, ln(n0 + 1.0) - ln(CAST(t0 + v AS DOUBLE)) AS theta0,
         ln(n1 + 1.0) - ln(CAST(t1 + v AS DOUBLE)) AS theta1
  FROM vocabulary, totals),
priors AS (
  SELECT ln(count(*) FILTER (WHERE label = 0) + 1.0) - ln(count(*) + 2.0) AS pi0,
         ln(count(*) FILTER (WHERE label = 1) + 1.0) - ln(count(*) + 2.0) AS pi1
  FROM labelled WHERE is_train),
scored AS ({scored}),
scored_words AS (SELECT doc_id, unnest({tokens('text')}) AS word FROM scored),
scored_terms AS (
  SELECT doc_id, word AS term, count(*) AS n FROM scored_words WHERE {NOT_STOP} GROUP BY ALL),
sums AS (
  SELECT doc_id, sum(n * theta0) AS s0, sum(n * theta1) AS s1
  FROM scored_terms JOIN theta USING (term) GROUP BY doc_id),
raws AS (
  SELECT s.doc_id, coalesce(s0, 0) + pi0 AS raw0, coalesce(s1, 0) + pi1 AS raw1
  FROM scored s LEFT JOIN sums ON sums.doc_id = s.doc_id, priors),
nb AS (
  SELECT doc_id, raw0, raw1, 1 / (1 + exp(least(raw0 - raw1, 700))) AS probability,
         CASE WHEN raw1 > raw0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM raws)"""


TEST_DOCUMENTS = "SELECT doc_id, text FROM labelled WHERE NOT is_train"
