"""Corpus-level operators: filters, concatenation, profiles, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def drop_null_text(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull())


def concat_same(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both tables, matched by column name, duplicates kept."""
    return first.unionByName(second)


def concat_mixed(first: DataFrame, second: DataFrame, message: str, *sources: str) -> DataFrame:
    """Concatenate tables with different columns and add the first text present as ``message``."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.withColumn(message, F.coalesce(*sources))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows of a stated order."""
    return df.orderBy(*order).limit(n)


def profile(df: DataFrame) -> DataFrame:
    """One row per column with its type, row count and NULL count, in a single scan."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"in_{i}") for i, c in enumerate(df.columns)])
    fields = [
        F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("column_type"), F.col("n_rows"),
                 (F.col("n_rows") - F.col(f"in_{i}")).alias("n_null"))
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*fields)))
