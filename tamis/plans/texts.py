"""Sources, filters, scalar functions, unions and sorts over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.functions import answers, text as tx
from tamis.functions.labels import repair_label
from tamis.operators import corpus
from tamis.operators.joins import derived_join
from tamis.operators.ranking import global_rank
from tamis.plans import sql
from tamis.plans.registry import query
from tamis.session import scratch_path
from tamis.sources import csv
from tamis.sources.tables import documents, inline_table, number_axis, table

# Names of the language codes.
LANGUAGE_NAMES = [("en", "English"), ("fr", "French"), ("de", "German"), ("es", "Spanish"), ("ru", "Russian")]


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of a conversation with the turn that follows it, if there is one."""
    turns = table(spark, folder, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.select("conv_id", "turn").join(following, ["conv_id", "turn"], "left")


def raw_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(label, text)`` with missing labels and labels above one."""
    marks = table(spark, folder, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("label"))
    return documents(spark, folder).join(marks, "doc_id", "left").select("label", "text")


def _fingerprints(corpus_table: DataFrame) -> DataFrame:
    return corpus_table.select(
        "label", F.md5("email").alias("email_md5"), F.length("email").cast("long").alias("n_chars")
    )


_CORPUS_SQL = f"""SELECT {sql.REPAIR.format('(l.quality + l.toxic)')} AS label, md5(text) AS email_md5,
  length(text) AS n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL"""


@query("src_csv_labelled", _CORPUS_SQL)
def src_csv_labelled(spark, folder):
    path = csv.write_csv(raw_corpus(spark, folder), scratch_path(spark, "corpus"))
    return _fingerprints(csv.read_labelled(spark, path))


@query("src_csv_inferred", _CORPUS_SQL)
def src_csv_inferred(spark, folder):
    path = csv.write_csv(raw_corpus(spark, folder), scratch_path(spark, "corpus"))
    return _fingerprints(csv.read_inferred(spark, path))


@query("src_inline_messages", f"""
SELECT v.language, count(d.doc_id) AS n_docs
FROM (VALUES {', '.join(f"('{c}', '{n}')" for c, n in LANGUAGE_NAMES)}) v(lang, language)
LEFT JOIN documents d ON d.lang = v.lang GROUP BY v.language""")
def src_inline_messages(spark, folder):
    names = inline_table(spark, LANGUAGE_NAMES, "lang string, language string")
    counts = table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return names.join(counts, "lang", "left").select("language", F.coalesce("n", F.lit(0)).alias("n_docs"))


@query("src_range", """
WITH lengths AS (SELECT length(text) // 1000 AS thousand, count(*) AS n FROM documents
                 WHERE text IS NOT NULL GROUP BY 1)
SELECT r.i AS thousand, coalesce(n, 0) AS n_docs
FROM range(0, (SELECT max(thousand) + 1 FROM lengths)) r(i) LEFT JOIN lengths ON thousand = r.i""")
def src_range(spark, folder):
    lengths = (
        documents(spark, folder).groupBy(F.floor(F.length("text") / 1000).alias("thousand"))
        .agg(F.count("*").alias("n"))
    )
    end = lengths.agg(F.max("thousand")).first()[0]
    axis = number_axis(spark, (end if end is not None else -1) + 1, "thousand")
    return axis.join(lengths, "thousand", "left").select("thousand", F.coalesce("n", F.lit(0)).alias("n_docs"))


def _profile_sql(name: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS column_type, count(*) AS n_rows, count(*) - count({c}) AS n_null "
        f"FROM {name}" for c, t in columns.items()
    )


@query("table_profile", _profile_sql("documents", {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}))
def table_profile(spark, folder):
    return corpus.profile(table(spark, folder, "documents"))


@query("label_repair", f"""
SELECT d.doc_id, {sql.REPAIR.format('(l.quality + l.toxic)')} AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def label_repair(spark, folder):
    marks = table(spark, folder, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("label"))
    return (
        table(spark, folder, "documents").select("doc_id").join(marks, "doc_id", "left")
        .select("doc_id", repair_label(F.col("label")).alias("label"))
    )


@query("drop_null_text", f"""
WITH {sql.REPLIES} SELECT conv_id, turn, md5(reply) AS reply_md5 FROM replies WHERE reply IS NOT NULL""")
def drop_null_text(spark, folder):
    kept = corpus.drop_null_text(replies(spark, folder), "reply")
    return kept.select("conv_id", "turn", F.md5("reply").alias("reply_md5"))


@query("long_text_filter", """
SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) > 500""")
def long_text_filter(spark, folder):
    return (
        documents(spark, folder).where(tx.is_long(F.col("text")))
        .select("doc_id", F.length("text").cast("long").alias("n_chars"))
    )


@query("truncate_text", """
SELECT doc_id, length(substr(text, 1, 4999)) AS n_chars, md5(substr(text, 1, 4999)) AS text_md5
FROM documents WHERE text IS NOT NULL""")
def truncate_text(spark, folder):
    short = documents(spark, folder).select("doc_id", tx.truncate(F.col("text")).alias("text"))
    return short.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("enrich_status", f"""
WITH {sql.REPLIES}
SELECT conv_id, turn, md5(coalesce(reply, '')) AS text_md5,
       CASE WHEN coalesce(reply, '') = '' THEN 'empty_text' ELSE '' END AS error FROM replies""")
def enrich_status(spark, folder):
    return replies(spark, folder).select(
        "conv_id", "turn", F.md5(F.coalesce("reply", F.lit(""))).alias("text_md5"),
        answers.request_fault(F.col("reply")).alias("error"),
    )


@query("validate_message", f"""
WITH {sql.REPLIES}, stripped AS (
  SELECT conv_id, turn, trim(coalesce(reply, ''), {sql.ANY_SPACE}) AS message FROM replies)
SELECT conv_id, turn, md5(message) AS message_md5,
       CASE WHEN message = '' THEN 'error' ELSE 'success' END AS status,
       CASE WHEN message = '' THEN 'Empty message' ELSE '' END AS error FROM stripped""")
def validate_message(spark, folder):
    checked = answers.clean_request(replies(spark, folder), "reply")
    return checked.select("conv_id", "turn", F.md5("reply").alias("message_md5"), "status",
                          F.coalesce("error", F.lit("")).alias("error"))


def _bodies(spark: SparkSession, folder: str, field: str) -> DataFrame:
    """Replies as JSON bodies; by the length of a reply some are cut off, in a list, or followed by other text."""
    body, kind = F.to_json(F.struct(F.col("reply").alias(field))), F.length("reply") % 5
    return replies(spark, folder).withColumn("body", F.when(kind == 0, F.substring(body, F.lit(1), F.length(body) - 1)).when(
        kind == 1, F.concat(F.lit("["), body, F.lit("]"))).when(kind == 2, F.concat(body, F.lit(" x"))).otherwise(body))


@query("parse_request", f"""
WITH {sql.REPLIES}
SELECT conv_id, turn, md5(CASE WHEN length(reply) % 5 < 3 THEN '' ELSE coalesce(reply, '') END) AS message_md5,
       CASE WHEN length(reply) % 5 < 3 THEN '{answers.MALFORMED}' ELSE '' END AS error FROM replies""")
def parse_request(spark, folder):
    requests = _bodies(spark, folder, "message").select("conv_id", "turn", answers.read_request(F.col("body")).alias("request"))
    return requests.select("conv_id", "turn", F.md5("request.message").alias("message_md5"), F.coalesce("request.error", F.lit("")).alias("error"))


@query("parse_translation", f"""
WITH {sql.REPLIES}
SELECT conv_id, turn, md5(CASE WHEN length(reply) % 5 < 3 THEN '' ELSE coalesce(reply, '') END) AS translated_md5,
       CASE WHEN length(reply) % 5 < 3 THEN 'bad_json' WHEN reply IS NULL THEN 'no_translatedText_in_response' ELSE '' END AS error
FROM replies""")
def parse_translation(spark, folder):
    translated, error = answers.parse_translation(F.col("body"))
    return _bodies(spark, folder, "translatedText").select("conv_id", "turn", F.md5(translated).alias("translated_md5"), error.alias("error"))


@query("cache_key", f"""
SELECT doc_id, 'spam:' || sha256(trim(text, {sql.ANY_SPACE})) AS key FROM documents WHERE text IS NOT NULL""")
def cache_key(spark, folder):
    return documents(spark, folder).select(
        "doc_id", answers.answer_key(tx.strip_message(F.col("text"))).alias("key")
    )


@query("strip_punct", f"""
SELECT doc_id, md5(translate(text, {sql.PUNCTUATION}, '')) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def strip_punct(spark, folder):
    return documents(spark, folder).select("doc_id", F.md5(tx.strip_punctuation(F.col("text"))).alias("text_md5"))


@query("sort_by_length", """
SELECT doc_id, length(text) AS n_chars, row_number() OVER (ORDER BY length(text), doc_id) AS rank
FROM documents WHERE text IS NOT NULL""")
def sort_by_length(spark, folder):
    lengths = documents(spark, folder).select("doc_id", F.length("text").cast("long").alias("n_chars"))
    return global_rank(lengths, [F.asc("n_chars"), F.asc("doc_id")], start=1)


@query("head_n", "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 1000")
def head_n(spark, folder):
    first = corpus.head(table(spark, folder, "documents"), 1000, "doc_id")
    return first.select("doc_id", F.md5("text").alias("text_md5"))


@query("concat_same", """
SELECT 'documents' AS origin, md5(text) AS message_md5 FROM documents
UNION ALL SELECT 'conversations', md5(text) FROM conversations""")
def concat_same(spark, folder):
    parts = [
        table(spark, folder, name).select(F.lit(name).alias("origin"), F.col("text").alias("message"))
        for name in ("documents", "conversations")
    ]
    return corpus.concat_same(*parts).select("origin", F.md5("message").alias("message_md5"))


@query("concat_mixed", f"""
WITH mixed AS (
  SELECT quality AS label, text FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL BY NAME
  SELECT CASE WHEN role = 'user' THEN 1 ELSE 0 END AS label, text AS translated FROM conversations)
SELECT {sql.REPAIR.format('label')} AS label, CASE WHEN text IS NULL THEN 1 ELSE 0 END AS would_drop,
       md5(coalesce(text, translated)) AS message_md5 FROM mixed""")
def concat_mixed(spark, folder):
    """Only what is kept of a text, here its digest, meets the label."""
    marks = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    original = derived_join(table(spark, folder, "documents").select("doc_id", "text"), marks, "doc_id",
                            lambda rows: rows.select("doc_id", F.md5("text").alias("text_md5")), "left").select("label", "text_md5")
    translated = table(spark, folder, "conversations").select(
        F.when(F.col("role") == "user", 1).otherwise(0).alias("label"), F.md5("text").alias("translated_md5")
    )
    mixed = corpus.concat_mixed(original, translated, "message_md5", "text_md5", "translated_md5")
    return mixed.select(repair_label(F.col("label")).alias("label"), F.col("text_md5").isNull().cast("int").alias("would_drop"), "message_md5")


@query("corpus_reconcile", """
SELECT count(*) AS n_records, count(*) FILTER (WHERE length(text) > 500) AS n_long,
       CAST(sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS n_lines
FROM documents WHERE text IS NOT NULL""")
def corpus_reconcile(spark, folder):
    path = csv.write_csv(raw_corpus(spark, folder), scratch_path(spark, "corpus"))
    records = csv.read_labelled(spark, path).agg(
        F.count("*").alias("n_records"), F.count_if(tx.is_long(F.col("email"))).alias("n_long")
    )
    # Each file begins with a header; a line of a text may look like one and still counts.
    files = csv.physical_lines(spark, path).groupBy(F.input_file_name().alias("file")).agg((F.count("*") - 1).alias("n"))
    # Both sides are one aggregated row.
    return records.withColumn("n_lines", files.agg(F.sum("n")).scalar())
