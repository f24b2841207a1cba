"""Scorer over sets of words: class share times the product of P(word | class)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tamis.operators.counting import class_counts, word_class_counts
from tamis.operators.joins import fits_broadcast, lookup
from tamis.session import materialize

UNKNOWN_WORD = 1e-6


def word_probability(count: Column, rows: int, alpha: float = UNKNOWN_WORD) -> Column:
    """Occurrences per row of the class; ``alpha`` for words the class has never used."""
    return F.when(F.coalesce(count, F.lit(0)) > 0, count / rows).otherwise(alpha)


def score_word_sets(train: DataFrame, train_words: str, label: str, df: DataFrame, words: str,
                    doc_id: str) -> DataFrame:
    """``(doc_id, log_ratio, probability)`` for every document of ``df``."""
    table = materialize(
        word_class_counts(train, train_words, label).withColumn("seen", F.col("spam") + F.col("ham")),
        "word-classes",
    )
    size = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("word") + 64).alias("bytes")).first()
    classes = class_counts(train, label).first()
    spam_rows = classes.n_one or 0
    ham_rows = (classes.n_rows or 0) - spam_rows
    rows = df.select(doc_id, F.explode_outer(F.array_distinct(words)).alias("word"))
    joined = lookup(rows, table, "word", fits_broadcast(size.n, size.bytes or 0), weight="seen")
    evidence = (
        F.log(word_probability(F.col("spam"), spam_rows)) - F.log(word_probability(F.col("ham"), ham_rows))
    )
    # A class without rows gets the share of an unknown word, so every document has a score.
    shares = [rows / classes.n_rows if rows else UNKNOWN_WORD for rows in (spam_rows, ham_rows)]
    prior = F.log(F.lit(shares[0])) - F.log(F.lit(shares[1]))
    return (
        joined.groupBy(doc_id)
        .agg((F.sum(F.when(F.col("word").isNotNull(), evidence).otherwise(0.0)) + prior).alias("log_ratio"))
        .withColumn("probability", 1 / (1 + F.exp(-F.col("log_ratio"))))
    )
