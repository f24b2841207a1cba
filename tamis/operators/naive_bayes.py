"""Multinomial naive Bayes as tables: training is one aggregate, the model is a table.

Neither the vocabulary nor the parameters ever need to fit on the driver. Formulas, with
N rows, n_c rows of class c, V terms, N_wc occurrences of term w in class c:
``pi_c = ln(n_c + s) - ln(N + 2 s)`` and ``theta_wc = ln(N_wc + s) - ln(N_c + V s)``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from tamis.operators.counting import term_rows, with_term_counts
from tamis.operators.joins import fits_broadcast, lookup
from tamis.operators.ranking import top_k
from tamis.session import materialize

_ROW_OVERHEAD = 64


@dataclass
class TermModel:
    """``terms`` holds ``term, n0, n1, theta0, theta1``."""

    terms: DataFrame
    pi0: float
    pi1: float
    size: int
    small: bool

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame(
            [(self.pi0, self.pi1, self.size, self.small)], "pi0 double, pi1 double, size long, small boolean"
        ).write.mode("overwrite").parquet(f"{path}/priors")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TermModel:
        priors = spark.read.parquet(f"{path}/priors").first()
        return TermModel(spark.read.parquet(f"{path}/terms"), priors.pi0, priors.pi1, priors.size, priors.small)


def _totals(stats: DataFrame) -> Row:
    known = F.col("term").isNotNull()

    def over(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    return stats.agg(
        F.count("term").alias("size"),
        over(known, F.col("n0")).alias("n0"), over(known, F.col("n1")).alias("n1"),
        over(~known, F.col("n0")).alias("docs0"), over(~known, F.col("n1")).alias("docs1"),
        over(known, F.octet_length("term") + _ROW_OVERHEAD).alias("bytes"),
    ).first()


def fit(df: DataFrame, words: str, label: str, vocab_size: int, min_df: int = 1,
        smoothing: float = 1.0) -> TermModel:
    """Count terms per class in one pass; keep the ``vocab_size`` most frequent terms."""
    return fit_counted(with_term_counts(df.select(label, words), words), "terms", label, vocab_size, min_df, smoothing)


def fit_counted(counted: DataFrame, terms: str, label: str, vocab_size: int, min_df: int = 1, smoothing: float = 1.0) -> TermModel:
    """The same from rows that hold their ``(term, n)`` counts already."""
    counted = counted.select(label, F.col(terms).alias("terms"))
    # One extra row per document, under the NULL term, carries the class sizes along.
    document_mark = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("n")))
    stats = (
        counted.select(label, F.inline_outer(F.concat(document_mark, "terms")))
        .groupBy("term")
        .agg(
            F.count("*").alias("df"),
            F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("n0"),
            F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("n1"),
        )
        .where(F.col("term").isNull() | (F.col("df") >= min_df))
    )
    written = materialize(stats, "term-stats")
    totals = _totals(written)
    docs0, docs1 = totals.docs0, totals.docs1
    vocabulary = written.where("term IS NOT NULL")
    if totals.size > vocab_size:
        order = [F.desc(F.col("n0") + F.col("n1")), F.asc("term")]
        vocabulary = materialize(top_k(vocabulary, vocab_size, order).drop("idx"), "term-model")
        totals = _totals(vocabulary)
    rows_log = log(docs0 + docs1 + 2 * smoothing)

    def theta(count: str, total: int):
        return F.log(F.col(count) + smoothing) - F.log(F.lit(total + totals.size * smoothing))

    return TermModel(
        terms=vocabulary.select("term", "n0", "n1", theta("n0", totals.n0).alias("theta0"),
                                theta("n1", totals.n1).alias("theta1")),
        pi0=log(docs0 + smoothing) - rows_log,
        pi1=log(docs1 + smoothing) - rows_log,
        size=totals.size,
        small=fits_broadcast(totals.size, totals.bytes),
    )


def score(model: TermModel, df: DataFrame, words: str, keep: list[str]) -> DataFrame:
    """``keep`` (which must contain a unique id) plus scores, probability and prediction.

    Unknown terms count nothing; a document without known terms gets the priors. All
    terms of a document sit in one task, so only one partial sum per document is shuffled.
    """
    rows = term_rows(df, words, keep, empty=True)
    table = model.terms.withColumn("weight", F.col("n0") + F.col("n1"))
    matched = lookup(rows, table, "term", model.small, weight="weight")
    sums = matched.groupBy(*keep).agg(
        F.coalesce(F.sum(F.col("n") * F.col("theta0")), F.lit(0.0)).alias("sum0"),
        F.coalesce(F.sum(F.col("n") * F.col("theta1")), F.lit(0.0)).alias("sum1"),
    )
    scored = sums.select(
        *keep, (F.col("sum0") + model.pi0).alias("raw0"), (F.col("sum1") + model.pi1).alias("raw1")
    )
    return scored.withColumns({
        "probability": 1 / (1 + F.exp(F.col("raw0") - F.col("raw1"))),
        "prediction": F.when(F.col("raw1") > F.col("raw0"), 1.0).otherwise(0.0),
    })
