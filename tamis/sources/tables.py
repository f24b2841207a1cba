"""Parquet inputs and tables made from literals or ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.functions.labels import repair_label
from tamis.operators.joins import derived_join


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(F.col("text").isNotNull())


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input of few splits; an input with enough splits stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, label``, repaired: low quality is the positive class."""
    return table(spark, folder, "labels").select("doc_id", repair_label(1 - F.col("quality")).alias("label"))


def labelled(spark: SparkSession, folder: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``derive`` makes of the documents ``doc_id, lang, text`` that have a label, with the label.

    It has to keep ``doc_id``. The label is joined to its result, so no text is shuffled for it.
    """
    texts = spread(documents(spark, folder).select("doc_id", "lang", "text"), "doc_id")
    return derived_join(texts, marks(spark, folder), "doc_id", derive)


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled texts themselves, for jobs that need texts and labels together."""
    return labelled(spark, folder, lambda texts: texts)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str = "email string") -> DataFrame:
    return spark.createDataFrame(rows, schema)


def number_axis(spark: SparkSession, end: int, name: str = "id") -> DataFrame:
    return spark.range(end).withColumnRenamed("id", name)
