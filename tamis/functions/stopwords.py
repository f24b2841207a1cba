"""Stop words per language, taken from the lists Spark ships."""

from __future__ import annotations

from functools import cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Language codes and the names of Spark's lists for them.
LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish", "ru": "russian"}


@cache
def stop_words(language: str = "english") -> tuple[str, ...]:
    return tuple(dict.fromkeys(StopWordsRemover.loadDefaultStopWords(language)))


def stop_word_table(spark: SparkSession, languages: dict[str, str] = LANGUAGES) -> DataFrame:
    """One row per (language code, word); a few hundred rows per language."""
    rows = [(code, word) for code, name in languages.items() for word in stop_words(name)]
    return spark.createDataFrame(rows, "lang string, word string")


@cache
def _word_list(language: str) -> str:
    """The words as SQL literals: one expression to parse instead of one call per word."""
    quoted = (word.lower().replace("\\", "\\\\").replace("'", "\\'") for word in stop_words(language))
    return ", ".join(f"'{word}'" for word in quoted)


def drop_stop_words(words: str, language: str = "english") -> Column:
    """Remove one language's stop words from a word-list column, ignoring case."""
    return F.expr(f"filter(`{words}`, word -> lower(word) NOT IN ({_word_list(language)}))")


def drop_stop_words_by_language(words: str, lang: Column,
                                languages: dict[str, str] = LANGUAGES) -> Column:
    """Remove the stop words of each row's own language; unknown codes keep all words."""
    chosen = None
    for code, name in languages.items():
        kept = drop_stop_words(words, name)
        chosen = F.when(lang == code, kept) if chosen is None else chosen.when(lang == code, kept)
    return chosen.otherwise(F.col(words))
