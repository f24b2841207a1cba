"""Reproducible vocabularies: position = feature index."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, functions as F

from tamis.operators.counting import term_rows, term_statistics
from tamis.operators.ranking import top_k
from tamis.session import scratch_path

# Vectors index their vocabulary on the driver; larger ones belong in the table-based model.
MAX_VECTOR_TERMS = 2_000_000


def frequency_vocabulary(df: DataFrame, words: str, size: int, min_df: int = 1) -> DataFrame:
    """``(idx, term, df, tf)`` by falling corpus frequency, ties by term.

    The order is total, so the result does not depend on partitioning.
    """
    stats = term_statistics(df, words).where(F.col("df") >= min_df)
    return top_k(stats, size, [F.desc("tf"), F.asc("term")]).select("idx", "term", "df", "tf")


def first_seen_vocabulary(df: DataFrame, words: str, doc_id: str, size: int) -> DataFrame:
    """``(idx, term, freq)`` by falling frequency, ties by first occurrence in the corpus."""
    # Both minima are plain numbers, so the aggregate stays a hash aggregate.
    stats = (
        term_rows(df, words, [doc_id], first=True).groupBy("term")
        .agg(F.sum("n").alias("freq"), F.min(doc_id).alias("first_doc"),
             F.min_by("first", doc_id).alias("first_at"))
    )
    order = [F.desc("freq"), F.asc("first_doc"), F.asc("first_at")]
    return top_k(stats, size, order).select("idx", "term", "freq")


def count_vectorizer(vocabulary: DataFrame, words: str, features: str,
                     binary: bool = False) -> CountVectorizerModel:
    """A fitted vectorizer over a vocabulary table (at most ``MAX_VECTOR_TERMS`` terms).

    The terms go from the table into the files of a saved model, which is then loaded:
    handing a long list over from Python costs a call per term.
    """
    spark = vocabulary.sparkSession
    path = scratch_path(spark, "vectorizer")
    template = CountVectorizerModel.from_vocabulary(["template"], inputCol=words, outputCol=features)
    template.setBinary(binary).write().save(path)
    # The limit bounds the one row of all terms whatever the vocabulary table holds.
    entries = F.array_sort(F.collect_list(F.struct("idx", "term")))
    vocabulary.limit(MAX_VECTOR_TERMS + 1).agg(
        F.transform(entries, lambda entry: entry["term"]).alias("vocabulary")
    ).write.mode("overwrite").parquet(f"{path}/data")
    if spark.read.parquet(f"{path}/data").select(F.size("vocabulary")).first()[0] > MAX_VECTOR_TERMS:
        raise ValueError("too many terms for vectors; use tamis.operators.naive_bayes")
    return CountVectorizerModel.load(path)


def vector_entries(df: DataFrame, features: str, keep: list[str]) -> DataFrame:
    """One row per stored entry ``(idx, value)`` of a sparse vector column."""
    raw = F.unwrap_udt(features)
    return df.select(*keep, F.inline(F.arrays_zip(raw["indices"].alias("idx"), raw["values"].alias("value"))))
