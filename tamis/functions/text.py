"""Text expressions. All are built-in column functions and stay inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# The characters Java's \s class matches.
JAVA_SPACE = " \t\n\x0b\f\r"
JAVA_SPACE_CLASS = r"[ \t\n\x0B\f\r]"

# Every character Python's str.strip() and str.split() treat as white space.
PYTHON_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

MAX_REQUEST_CHARS = 4999
LONG_TEXT_CHARS = 500


def tokenize(text: Column) -> Column:
    """Lower-case and split on single white-space characters.

    Same result as the ML ``Tokenizer``: inner and leading empty tokens stay,
    trailing ones go, ``""`` gives ``[""]`` and an all-blank text gives ``[]``.
    """
    lowered = F.lower(text)
    body = F.rtrim(lowered, F.lit(JAVA_SPACE))
    only_blanks = (body == "") & (lowered != "")
    return F.when(only_blanks, F.array().cast("array<string>")).otherwise(
        F.split(body, JAVA_SPACE_CLASS)
    )


def strip_message(text: Column) -> Column:
    """Remove leading and trailing white space of any kind, as ``str.strip`` does."""
    return F.trim(text, F.lit(PYTHON_SPACE))


def strip_punctuation(text: Column) -> Column:
    """Delete the ASCII punctuation characters."""
    return F.translate(text, string.punctuation, "")


def whitespace_words(text: Column) -> Column:
    """Split on runs of white space, without empty words, as ``str.split()`` does."""
    return F.filter(F.split(text, f"[{PYTHON_SPACE}]+"), lambda word: word != "")


def bag_words(text: Column, longer_than: int = 2) -> Column:
    """Lower-case words without punctuation, longer than two characters."""
    cleaned = strip_punctuation(F.lower(text))
    return F.filter(F.split(cleaned, f"[{PYTHON_SPACE}]+"), lambda word: F.length(word) > longer_than)


def is_long(text: Column, limit: int = LONG_TEXT_CHARS) -> Column:
    return F.length(text) > limit


def truncate(text: Column, limit: int = MAX_REQUEST_CHARS) -> Column:
    return F.substring(text, 1, limit)
