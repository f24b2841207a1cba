"""Rows every operator must take: NULLs, empty and very long texts, repeated rows, clashing columns."""

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[i * i % 20] + str(i) for i in range(30_000))
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 1),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 1),
    (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 1),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "b", 3),
    (6, LONG, "de", "b", 9),
    (7, "über ñandú – çà \x1f 日本語 😀\r\nüber", "es", "b", 2),
    (None, "no id here but words enough to pass the rule of ten words", "fr", "c", 2),
    (9, "one two three four five " * 6, "en", "c", 2),
]
EXTRA = ["score", "fingerprint", "component", "tokens", "kept", "weight", "key", "value", "_fingerprint", "_n_tokens", "word", "part"]


def documents(spark):
    return spark.createDataFrame(ROWS, SHAPE)


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def empty(spark):
    return spark.createDataFrame([], SHAPE)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
