"""Word and term counting.

Counts inside one document are computed inside its row (sort, then run lengths), so
nothing is shuffled per document. Corpus-wide counts group by word after that; the
map-side partial aggregate collapses frequent words before they reach a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def word_rows(df: DataFrame, words: str, keep: list[str], out: str = "word") -> DataFrame:
    """One row per word occurrence.

    The outer generator keeps the optimizer from adding a non-empty check below the
    explode, which would compute the word list of every document twice.
    """
    return df.select(*keep, F.explode_outer(words).alias(out)).where(F.col(out).isNotNull())


def with_term_counts(df: DataFrame, words: str, out: str = "terms", first: bool = False) -> DataFrame:
    """Replace a word list by an array of ``(term, n)`` structs, one per distinct word.

    ``first`` adds the position of the term's first occurrence in the list.
    """
    ordered, starts = f"__{out}_sorted", f"__{out}_starts"
    at = F.col(ordered)
    placed = F.transform(words, lambda word, i: F.struct(word.alias("term"), i.alias("first"))) if first else words

    def term_at(i: Column) -> Column:
        return F.get(at, i)["term"] if first else F.get(at, i)

    def entry(run: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col(starts), i + 1), F.size(at))
        place = [F.get(at, run)["first"].alias("first")] if first else []
        return F.struct(term_at(run).alias("term"), (end - run).cast("long").alias("n"), *place)

    return (
        df.withColumn(ordered, F.sort_array(placed))
        .withColumn(
            starts,
            F.filter(
                F.transform(at, lambda _, i: i), lambda i: (i == 0) | (term_at(i - 1) != term_at(i))
            ),
        )
        .withColumn(out, F.transform(starts, entry))
        .drop(ordered, starts, words)
    )


def term_rows(df: DataFrame, words: str, keep: list[str], empty: bool = False, first: bool = False) -> DataFrame:
    """One row per document and distinct term with its count ``n``.

    With ``empty``, documents without terms keep one row with a NULL term.
    """
    counted = with_term_counts(df.select(*keep, words), words, first=first)
    rows = counted.select(*keep, F.inline_outer("terms"))
    return rows if empty else rows.where(F.col("term").isNotNull())


def word_frequencies(df: DataFrame, words: str) -> DataFrame:
    return word_rows(df, words, []).groupBy("word").agg(F.count("*").alias("freq"))


def word_class_counts(df: DataFrame, words: str, label: str) -> DataFrame:
    """Occurrences of every word in spam and in ham."""
    return (
        word_rows(df, words, [label])
        .groupBy("word")
        .agg(
            F.count_if(F.col(label) == 1).alias("spam"),
            F.count_if(F.col(label) != 1).alias("ham"),
        )
    )


def spam_ratio(spam: Column, ham: Column) -> Column:
    return spam / (spam + ham)


def term_statistics(df: DataFrame, words: str) -> DataFrame:
    """Document frequency ``df`` and corpus frequency ``tf`` of every term."""
    return (
        term_rows(df, words, [])
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("n").alias("tf"))
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Total, positive, exact one and zero labels in one pass."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(label) > 0).alias("n_positive"),
        F.count_if(F.col(label) == 1).alias("n_one"),
        F.count_if(F.col(label) == 0).alias("n_zero"),
    )
