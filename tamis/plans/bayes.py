"""Naive Bayes from training to verdicts, metrics and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tamis.functions import answers, stopwords, text as tx
from tamis.operators import answer_cache, counting, messages, metrics, naive_bayes, splits, word_bayes
from tamis.plans import sql
from tamis.plans.features import labelled_words
from tamis.plans.registry import query
from tamis.session import materialize, scratch_path
from tamis.sources.answer_store import AnswerStore
from tamis.sources.tables import documents, labelled, labelled_documents, spread, table
from tamis.streaming import answer_cache as cache_stream, scoring

VOCAB_SIZE = 500_000
MIN_DF = 5


def with_words(df: DataFrame, message: str) -> DataFrame:
    return df.withColumn("words", tx.tokenize(F.col(message))).withColumn("words", stopwords.drop_stop_words("words"))


def train_model(spark: SparkSession, folder: str) -> naive_bayes.TermModel:
    """Term counts of the training documents get their label; their texts and words stay where they are."""
    def counted(texts: DataFrame) -> DataFrame:
        words = with_words(texts.where(splits.in_share("doc_id")), "text").select("doc_id", "words")
        return counting.with_term_counts(words, "words")

    return naive_bayes.fit_counted(labelled(spark, folder, counted), "terms", "label", VOCAB_SIZE, MIN_DF)


def test_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the test documents, then their labels."""
    model = train_model(spark, folder)

    def score(texts: DataFrame) -> DataFrame:
        return naive_bayes.score(model, with_words(texts.where(~splits.in_share("doc_id")), "text"), "words", ["doc_id"])

    return labelled(spark, folder, score)


def all_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The functions of a single message are shown on every document."""
    words = with_words(spread(documents(spark, folder).select("doc_id", "text"), "doc_id"), "text")
    return naive_bayes.score(train_model(spark, folder), words, "words", ["doc_id"])


def _probability():
    return F.round("probability", 4).alias("probability")


@query("nb_train", f"""
WITH {sql.naive_bayes(sql.TEST_DOCUMENTS)}
SELECT term, n0, n1, round(theta0, 6) AS theta0, round(theta1, 6) AS theta1,
       round(pi0, 6) AS pi0, round(pi1, 6) AS pi1 FROM theta, priors""")
def nb_train(spark, folder):
    model = train_model(spark, folder)
    return model.terms.select(
        "term", "n0", "n1", F.round("theta0", 6).alias("theta0"), F.round("theta1", 6).alias("theta1"),
        F.round(F.lit(model.pi0), 6).alias("pi0"), F.round(F.lit(model.pi1), 6).alias("pi1"),
    )


_SCORED = f"WITH {sql.naive_bayes(sql.TEST_DOCUMENTS)}"
_EVALUATED = f"""{_SCORED},
evaluated AS (SELECT label, prediction FROM nb JOIN labelled USING (doc_id))"""


@query("nb_score", f"""{_SCORED}
SELECT doc_id, label, prediction, round(probability, 4) AS probability FROM nb JOIN labelled USING (doc_id)""")
def nb_score(spark, folder):
    return test_scores(spark, folder).select("doc_id", "label", "prediction", _probability())


@query("nb_confusion", f"""{_EVALUATED}
SELECT label, CAST(prediction AS INTEGER) AS prediction, count(*) AS n FROM evaluated GROUP BY ALL""")
def nb_confusion(spark, folder):
    return metrics.confusion_matrix(test_scores(spark, folder))


@query("confusion_matrix", f"""
WITH {sql.LABELLED}
SELECT label, toxic AS prediction, count(*) AS n FROM labelled JOIN labels USING (doc_id) GROUP BY ALL""")
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_toxicity_as_prediction(spark, folder))


def _toxicity_as_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity mark taken as a prediction of low quality."""
    marks = table(spark, folder, "labels").select(
        "doc_id", F.col("toxic").cast("double").alias("prediction"))
    return labelled_documents(spark, folder).select("doc_id", "label").join(marks, "doc_id")


@query("metric_accuracy", f"""{_EVALUATED}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE label = prediction) AS n_correct,
       round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM evaluated""")
def metric_accuracy(spark, folder):
    return metrics.accuracy(test_scores(spark, folder)).withColumn("accuracy", F.round("accuracy", 6))


@query("metrics_weighted", f"""{_EVALUATED},
classes AS (SELECT DISTINCT label AS c FROM evaluated),
per_class AS (
  SELECT c, count(*) FILTER (WHERE label = c) AS true_n, count(*) FILTER (WHERE prediction = c) AS said_n,
         count(*) FILTER (WHERE label = c AND prediction = c) AS hit_n FROM evaluated, classes GROUP BY c),
ratios AS (
  SELECT *, CASE WHEN said_n = 0 THEN 0 ELSE hit_n / said_n END AS p,
         CASE WHEN true_n = 0 THEN 0 ELSE hit_n / true_n END AS r FROM per_class),
scores AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM ratios)
SELECT CAST(sum(true_n) AS BIGINT) AS n_rows, round(sum(hit_n) / sum(true_n), 6) AS accuracy,
       round(sum(f * true_n) / sum(true_n), 6) AS f1,
       round(sum(p * true_n) / sum(true_n), 6) AS weighted_precision,
       round(sum(r * true_n) / sum(true_n), 6) AS weighted_recall FROM scores""")
def metrics_weighted(spark, folder):
    row = metrics.weighted_metrics(test_scores(spark, folder))
    return row.select("n_rows", *[F.round(c, 6).alias(c) for c in row.columns[1:]])


_ALL_SCORED = f"WITH {sql.naive_bayes('SELECT doc_id, text FROM documents WHERE text IS NOT NULL')}"


@query("verdict", f"""{_ALL_SCORED}
SELECT doc_id, CASE WHEN probability > 0.5 THEN 'SPAM' ELSE 'NOT SPAM' END AS result FROM nb""")
def verdict(spark, folder):
    return all_scores(spark, folder).select("doc_id", answers.verdict(F.col("probability")).alias("result"))


@query("confidence_pct", f"""{_ALL_SCORED}, percents AS (
  SELECT doc_id, round(probability, 4) * 100 AS percent FROM nb)
SELECT doc_id, printf('%.2f%%', percent + CASE WHEN percent * 8 = floor(percent * 8) THEN 0.001 ELSE 0 END)
  AS confidence FROM percents""")
def confidence_pct(spark, folder):
    return all_scores(spark, folder).select(
        "doc_id", answers.confidence_percent(F.round("probability", 4)).alias("confidence")
    )


_ANSWER_SQL = """'{"status":"success","result":"' || CASE WHEN probability > 0.5 THEN 'SPAM' ELSE 'NOT SPAM' END
  || '","probability":' || CAST(CAST(round(probability, 4) AS DECIMAL(5, 4)) AS VARCHAR) || '}'"""


def _answer(status=None, error=None):
    return answers.answer_json(
        F.lit("success") if status is None else status, answers.verdict(F.col("probability")),
        F.round("probability", 4).cast("decimal(5,4)"), F.lit(None).cast("string") if error is None else error,
    )


@query("verdict_json", f"{_ALL_SCORED} SELECT doc_id, {_ANSWER_SQL} AS answer FROM nb")
def verdict_json(spark, folder):
    return all_scores(spark, folder).select("doc_id", _answer().alias("answer"))


def _wordset_sql() -> str:
    return f"""
WITH {sql.LABELLED},
train_words AS (SELECT label, unnest({sql.tokens('text')}) AS word FROM labelled WHERE is_train),
counts AS (
  SELECT word, count(*) FILTER (WHERE label = 1) AS spam, count(*) FILTER (WHERE label <> 1) AS ham
  FROM train_words WHERE {sql.NOT_STOP} GROUP BY word),
classes AS (
  SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label <> 1) AS n0
  FROM labelled WHERE is_train),
sets AS (
  SELECT DISTINCT doc_id, unnest(list_filter(string_split_regex(text, '[' || {sql.ANY_SPACE} || ']+'),
         lambda w: w <> '')) AS word FROM labelled WHERE NOT is_train),
evidence AS (
  SELECT doc_id, sum(ln(CASE WHEN spam > 0 THEN spam / n1 ELSE 1e-6 END)
                     - ln(CASE WHEN ham > 0 THEN ham / n0 ELSE 1e-6 END)) AS s
  FROM sets LEFT JOIN counts USING (word), classes GROUP BY doc_id),
ratios AS (
  SELECT doc_id, coalesce(s, 0) + ln(n1 / (n1 + n0)) - ln(n0 / (n1 + n0)) AS log_ratio
  FROM labelled LEFT JOIN evidence USING (doc_id), classes WHERE NOT is_train)
SELECT doc_id, round(log_ratio, 4) AS log_ratio, round(1 / (1 + exp(least(-log_ratio, 700))), 4) AS probability
FROM ratios"""


@query("nb_manual_score", _wordset_sql())
def nb_manual_score(spark, folder):
    train, _ = splits.hash_split(labelled_words(spark, folder), "doc_id")
    _, test = splits.hash_split(labelled_documents(spark, folder), "doc_id")
    test = test.select("doc_id", tx.whitespace_words(F.col("text")).alias("words"))
    scored = word_bayes.score_word_sets(train, "words", "label", test, "words", "doc_id")
    return scored.select("doc_id", F.round("log_ratio", 4).alias("log_ratio"), _probability())


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """Stored answers: one per distinct message among the labelled documents."""
    key = answers.answer_key(tx.strip_message(F.col("text")))
    return (
        labelled_documents(spark, folder).select("doc_id", "label", key.alias("key"))
        .groupBy("key").agg(F.min_by("label", "doc_id").alias("stored_label"))
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and keys, written once: the join reads them twice, the texts only need hashing once."""
    key = answers.answer_key(tx.strip_message(F.col("text")))
    return materialize(documents(spark, folder).select("doc_id", key.alias("key")), "requests")


_CACHE = f"""
WITH {sql.LABELLED},
cache AS (SELECT 'spam:' || sha256(trim(text, {sql.ANY_SPACE})) AS key, arg_min(label, doc_id) AS stored_label
          FROM labelled GROUP BY 1),
requests AS (SELECT doc_id, 'spam:' || sha256(trim(text, {sql.ANY_SPACE})) AS key
             FROM documents WHERE text IS NOT NULL)"""


@query("cache_hits", f"{_CACHE} SELECT doc_id, key, stored_label FROM requests JOIN cache USING (key)")
def cache_hits(spark, folder):
    hits = answer_cache.cached_answers(requests(spark, folder), answered(spark, folder), "key")
    return hits.select("doc_id", "key", "stored_label")


@query("cache_misses", f"{_CACHE} SELECT doc_id, key FROM requests WHERE key NOT IN (SELECT key FROM cache)")
def cache_misses(spark, folder):
    return answer_cache.uncached_requests(requests(spark, folder), answered(spark, folder), "key").select("doc_id", "key")


_CACHE_TTL = """
WITH RECURSIVE requests AS (
  SELECT event_id, user_id || ':' || event_type AS key, epoch_us(ts) AS micros,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
replay AS (
  SELECT event_id, key, n, micros + 86400000000 AS expires, 0 AS hit FROM requests WHERE n = 1
  UNION ALL
  SELECT q.event_id, q.key, q.n,
         CASE WHEN q.micros >= r.expires THEN q.micros + 86400000000 ELSE r.expires END,
         CASE WHEN q.micros >= r.expires THEN 0 ELSE 1 END
  FROM replay r JOIN requests q ON q.key = r.key AND q.n = r.n + 1)
SELECT event_id, key, hit FROM replay"""


@query("cache_ttl", _CACHE_TTL)
def cache_ttl(spark, folder):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    replayed = answer_cache.replay_cache(
        table(spark, folder, "events"), key, F.col("ts"), F.col("event_id")
    )
    return replayed.select(F.col("id").alias("event_id"), "key", F.col("hit").cast("int").alias("hit"))


@query("cache_ttl_stream", """
WITH RECURSIVE requests AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS micros, event_type <> 'error' AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
replay AS (
  SELECT event_id, key, n, CASE WHEN ok THEN micros + 86400000000 ELSE 0 END AS expires, 0 AS hit FROM requests WHERE n = 1
  UNION ALL
  SELECT q.event_id, q.key, q.n,
         CASE WHEN q.micros >= r.expires AND q.ok THEN q.micros + 86400000000 ELSE r.expires END,
         CASE WHEN q.micros >= r.expires THEN 0 ELSE 1 END
  FROM replay r JOIN requests q ON q.key = r.key AND q.n = r.n + 1)
SELECT event_id, key, hit FROM replay""")
def cache_ttl_stream(spark, folder):
    """The log as a stream, one key for each user; every request is answered, and those that fail store nothing."""
    schema = table(spark, folder, "events").schema
    requests = spark.readStream.schema(schema).parquet(f"{folder}/events.{{parquet}}")
    replayed = cache_stream.cache_stream(requests, F.col("user_id").cast("string"), F.col("ts"), F.col("event_id"), ok=F.col("event_type") != "error")
    sink = scratch_path(spark, "stream-cache")
    cache_stream.write_available(replayed, sink, scratch_path(spark, "stream-checkpoint"))
    answered = spark.read.schema(replayed.schema).parquet(sink)
    return answered.select(F.col("id").alias("event_id"), "key", F.col("hit").cast("int").alias("hit"))


_MESSAGES = f"""
WITH {sql.naive_bayes("SELECT doc_id, coalesce(text, '') AS text FROM documents")},
messages AS (SELECT doc_id, trim(coalesce(text, ''), {sql.ANY_SPACE}) AS message FROM documents),
answers AS (
  SELECT doc_id, CASE WHEN message = '' THEN '{{"status":"error","error":"{answers.EMPTY_MESSAGE}"}}' ELSE {_ANSWER_SQL} END AS answer,
         message <> '' AS valid, CASE WHEN message <> '' AND row_number() OVER (PARTITION BY message ORDER BY doc_id) > 1 THEN 1 ELSE 0 END AS repeated
  FROM nb JOIN messages USING (doc_id))"""


def _answer_all(spark: SparkSession, folder: str, store: AnswerStore, model: naive_bayes.TermModel, now: Column) -> DataFrame:
    """Every document's text as a JSON request."""
    requests = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("id"), F.to_json(F.struct(F.col("text").alias("message"))).alias("body"))

    def score(rows: DataFrame) -> DataFrame:
        return naive_bayes.score(model, with_words(rows, "message"), "words", ["id"])

    return messages.answer_requests(requests, store, score, now).withColumnRenamed("id", "doc_id")


@query("score_messages", f"{_MESSAGES} SELECT doc_id, answer, repeated AS cached FROM answers")
def score_messages(spark, folder):
    """JSON requests in, JSON answers out, with an answer store that is empty at first."""
    store = AnswerStore(spark, scratch_path(spark, "answer-store"))
    return _answer_all(spark, folder, store, train_model(spark, folder), F.lit("2024-01-01").cast("timestamp"))


@query("score_messages_cached", f"""{_MESSAGES}
SELECT hours, doc_id, answer, CASE WHEN hours = 23 THEN CAST(valid AS INTEGER) ELSE repeated END AS cached
FROM answers, (VALUES (0), (23), (24)) AS calls(hours)""")
def score_messages_cached(spark, folder):
    """The same requests at once, after 23 hours, when every answer is still there, and after 24, when none is."""
    store, model = AnswerStore(spark, scratch_path(spark, "answer-store")), train_model(spark, folder)
    calls = []
    for hours in (0, 23, 24):
        now = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))
        calls.append(_answer_all(spark, folder, store, model, now).select(F.lit(hours).alias("hours"), "*"))
    return reduce(DataFrame.unionByName, calls)


@query("score_stream", f"""{_ALL_SCORED}
SELECT doc_id, prediction, round(probability, 4) AS probability FROM nb""")
def score_stream(spark, folder):
    model = train_model(spark, folder)

    def score(batch: DataFrame) -> DataFrame:
        rows = spread(batch.where(F.col("text").isNotNull()).select("doc_id", "text"), "doc_id")
        return naive_bayes.score(model, with_words(rows, "text"), "words", ["doc_id"])

    # A streaming source takes a folder or a glob; this one matches exactly the table.
    source, sink = f"{folder}/documents.{{parquet}}", scratch_path(spark, "stream-answers")
    schema = table(spark, folder, "documents").schema
    scoring.score_stream(spark, source, schema, score, sink, scratch_path(spark, "stream-checkpoint")).awaitTermination()
    return scoring.scored(spark, sink).select("doc_id", "prediction", _probability())
