"""Tokens, counts, vocabularies, vectors and splits over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.functions import stopwords, text as tx
from tamis.operators import counting, splits, vocabulary
from tamis.operators.joins import lookup
from tamis.plans import sql
from tamis.plans.registry import query
from tamis.session import scratch_path
from tamis.sources import csv, exports
from tamis.sources.tables import documents, labelled_documents, spread, table

BAG_SIZE = 1000
VOCAB_SIZE = 10_000
LARGE_VOCAB_SIZE = 50_000


def tokenized(spark: SparkSession, folder: str) -> DataFrame:
    return spread(documents(spark, folder), "doc_id").select("doc_id", "lang", tx.tokenize(F.col("text")).alias("words"))


def filtered(spark: SparkSession, folder: str) -> DataFrame:
    return tokenized(spark, folder).withColumn("words", stopwords.drop_stop_words("words"))


def bagged(spark: SparkSession, folder: str) -> DataFrame:
    return spread(documents(spark, folder), "doc_id").select("doc_id", tx.bag_words(F.col("text")).alias("words"))


def labelled_words(spark: SparkSession, folder: str) -> DataFrame:
    return labelled_documents(spark, folder).select(
        "doc_id", "label", tx.tokenize(F.col("text")).alias("words")
    ).withColumn("words", stopwords.drop_stop_words("words"))


def _list_digest(df: DataFrame, words: str = "words") -> DataFrame:
    return df.select("doc_id", F.size(words).cast("long").alias("n_words"),
                     F.md5(F.concat_ws("\n", words)).alias("words_md5"))


def _list_digest_sql(words: str) -> str:
    return f"""
WITH lists AS (SELECT doc_id, {words} AS words FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(words) AS n_words, md5(array_to_string(words, chr(10))) AS words_md5 FROM lists"""


@query("tokenize", _list_digest_sql(sql.tokens("text")))
def tokenize(spark, folder):
    return _list_digest(tokenized(spark, folder))


@query("bow_tokens", _list_digest_sql(sql.bag("text")))
def bow_tokens(spark, folder):
    return _list_digest(bagged(spark, folder))


@query("stopwords_en", _list_digest_sql(
    f"list_filter({sql.tokens('text')}, lambda w: w NOT IN ({sql.word_list('english')}))"))
def stopwords_en(spark, folder):
    return _list_digest(filtered(spark, folder))


@query("stopwords_by_lang", _list_digest_sql(
    "CASE lang " + " ".join(
        f"WHEN '{code}' THEN list_filter({sql.tokens('text')}, lambda w: w NOT IN ({sql.word_list(name)}))"
        for code, name in stopwords.LANGUAGES.items()
    ) + f" ELSE {sql.tokens('text')} END"))
def stopwords_by_lang(spark, folder):
    kept = stopwords.drop_stop_words_by_language("words", F.col("lang"))
    return _list_digest(tokenized(spark, folder).withColumn("words", kept))


_FILTERED = f"""raw_words AS (
  SELECT doc_id, unnest({sql.tokens('text')}) AS word FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, word FROM raw_words WHERE {sql.NOT_STOP})"""

_LABELLED_WORDS = f"""{sql.LABELLED},
raw_words AS (SELECT doc_id, label, unnest({sql.tokens('text')}) AS word FROM labelled),
words AS (SELECT doc_id, label, word FROM raw_words WHERE {sql.NOT_STOP})"""


@query("class_counts", f"""
WITH {sql.LABELLED}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE label > 0) AS n_positive,
       count(*) FILTER (WHERE label = 1) AS n_one, count(*) FILTER (WHERE label = 0) AS n_zero FROM labelled""")
def class_counts(spark, folder):
    return counting.class_counts(labelled_documents(spark, folder), "label")


@query("word_class_counts", f"""
WITH {_LABELLED_WORDS}
SELECT word, count(*) FILTER (WHERE label = 1) AS spam, count(*) FILTER (WHERE label <> 1) AS ham
FROM words GROUP BY word""")
def word_class_counts(spark, folder):
    return counting.word_class_counts(labelled_words(spark, folder), "words", "label")


@query("word_spam_ratio", f"""
WITH {_LABELLED_WORDS}
SELECT word, round(count(*) FILTER (WHERE label = 1) / count(*), 6) AS ratio FROM words GROUP BY word""")
def word_spam_ratio(spark, folder):
    counts = counting.word_class_counts(labelled_words(spark, folder), "words", "label")
    return counts.select("word", F.round(counting.spam_ratio(F.col("spam"), F.col("ham")), 6).alias("ratio"))


_BAG_WORDS = f"""words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, {sql.bag('text')} AS w FROM documents WHERE text IS NOT NULL))"""

_BAG_VOCABULARY = f"""{_BAG_WORDS},
ranked AS (
  SELECT word, count(*) AS freq, min(doc_id * 10000000 + pos) AS first_seen FROM words GROUP BY word),
vocabulary AS (
  SELECT row_number() OVER (ORDER BY freq DESC, first_seen) - 1 AS idx, word AS term, freq
  FROM ranked ORDER BY idx LIMIT {BAG_SIZE})"""


@query("word_freq", f"WITH {_BAG_WORDS} SELECT word, count(*) AS freq FROM words GROUP BY word")
def word_freq(spark, folder):
    return counting.word_frequencies(bagged(spark, folder), "words")


@query("vocab_topk", f"WITH {_BAG_VOCABULARY} SELECT term, freq FROM vocabulary")
def vocab_topk(spark, folder):
    return vocabulary.first_seen_vocabulary(bagged(spark, folder), "words", "doc_id", BAG_SIZE).select("term", "freq")


@query("vocab_index", f"WITH {_BAG_VOCABULARY} SELECT idx, term FROM vocabulary")
def vocab_index(spark, folder):
    return vocabulary.first_seen_vocabulary(bagged(spark, folder), "words", "doc_id", BAG_SIZE).select("idx", "term")


_BAG_PRESENCE = f"""
WITH {_BAG_VOCABULARY}
SELECT DISTINCT doc_id, idx FROM words JOIN vocabulary ON term = word"""


@query("bow_presence", _BAG_PRESENCE)
def bow_presence(spark, folder):
    docs = bagged(spark, folder)
    terms = vocabulary.first_seen_vocabulary(docs, "words", "doc_id", BAG_SIZE)
    vectors = vocabulary.count_vectorizer(terms, "words", "features", binary=True).transform(docs)
    return vocabulary.vector_entries(vectors, "features", ["doc_id"]).select("doc_id", F.col("idx").cast("long"))


@query("token_lookup", _BAG_PRESENCE)
def token_lookup(spark, folder):
    docs = bagged(spark, folder)
    terms = vocabulary.first_seen_vocabulary(docs, "words", "doc_id", BAG_SIZE).select("term", "idx")
    distinct = counting.word_rows(docs.withColumn("words", F.array_distinct("words")), "words", ["doc_id"], "term")
    # The vocabulary holds at most BAG_SIZE rows.
    return lookup(distinct, terms, "term", small=True).where(F.col("idx").isNotNull()).select("doc_id", "idx")


@query("vocab_min_df", f"""
WITH {_FILTERED}
SELECT word AS term, count(DISTINCT doc_id) AS df, count(*) AS tf
FROM words GROUP BY word HAVING count(DISTINCT doc_id) >= 5""")
def vocab_min_df(spark, folder):
    return counting.term_statistics(filtered(spark, folder), "words").where(F.col("df") >= 5)


@query("term_counts", f"WITH {_FILTERED} SELECT doc_id, word AS term, count(*) AS n FROM words GROUP BY doc_id, word")
def term_counts(spark, folder):
    return counting.term_rows(filtered(spark, folder), "words", ["doc_id"])


def _vocabulary_sql(size: int, min_df: int = 1) -> str:
    return f"""{_FILTERED},
ranked AS (
  SELECT word AS term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM words
  GROUP BY word HAVING count(DISTINCT doc_id) >= {min_df}),
vocabulary AS (
  SELECT row_number() OVER (ORDER BY tf DESC, term) - 1 AS idx, term, df, tf FROM ranked
  ORDER BY idx LIMIT {size})"""


@query("vocab_topk_cv", f"WITH {_vocabulary_sql(VOCAB_SIZE)} SELECT idx, term, df, tf FROM vocabulary")
def vocab_topk_cv(spark, folder):
    return vocabulary.frequency_vocabulary(filtered(spark, folder), "words", VOCAB_SIZE)


@query("vocab_export", f"WITH {_vocabulary_sql(LARGE_VOCAB_SIZE)} SELECT term FROM vocabulary")
def vocab_export(spark, folder):
    terms = vocabulary.frequency_vocabulary(filtered(spark, folder), "words", LARGE_VOCAB_SIZE)
    path = exports.export_vocabulary(terms, scratch_path(spark, "vocabulary"))
    return csv.read_csv(spark, path, "term string")


@query("count_vectors", f"""
WITH {_vocabulary_sql(VOCAB_SIZE)}
SELECT doc_id, idx, count(*) AS n FROM words JOIN vocabulary ON term = word GROUP BY doc_id, idx""")
def count_vectors(spark, folder):
    docs = filtered(spark, folder)
    terms = vocabulary.frequency_vocabulary(docs, "words", VOCAB_SIZE)
    vectors = vocabulary.count_vectorizer(terms, "words", "features").transform(docs)
    return vocabulary.vector_entries(vectors, "features", ["doc_id"]).select(
        "doc_id", F.col("idx").cast("long"), F.col("value").cast("long").alias("n")
    )


@query("hash_split", f"SELECT doc_id, CASE WHEN {sql.in_share()} THEN 'train' ELSE 'test' END AS part FROM documents")
def hash_split(spark, folder):
    part = F.when(splits.in_share("doc_id"), "train").otherwise("test")
    return table(spark, folder, "documents").select("doc_id", part.alias("part"))


@query("exact_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)))
                      <= (SELECT CAST(floor(0.7 * count(*)) AS BIGINT) FROM documents)
                    THEN 'train' ELSE 'test' END AS part FROM documents""")
def exact_split(spark, folder):
    train, test = splits.exact_split(table(spark, folder, "documents").select("doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
