"""Requests, verdicts and the JSON answers of the scoring service."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.text import strip_message

# Wording of the answers, key prefix and lifetime of a stored answer.
SPAM, NOT_SPAM = "SPAM", "NOT SPAM"
EMPTY_MESSAGE = "Empty message"
MALFORMED = "Malformed request"
EMPTY_TEXT = "empty_text"
KEY_PREFIX = "spam:"
ANSWER_TTL_SECONDS = 86400


def verdict(probability: Column, threshold: float = 0.5) -> Column:
    """Strictly above the threshold is spam."""
    return F.when(probability > threshold, SPAM).otherwise(NOT_SPAM)


def confidence_percent(probability: Column) -> Column:
    """Percent with two decimals; exact halves go up, as a browser's toFixed(2) prints them."""
    percent = probability * 100
    tie = percent * 8 == F.floor(percent * 8)
    nudged = percent + F.when(tie, 0.001).otherwise(0.0)
    return F.concat(F.format_number(nudged, 2), F.lit("%"))


def is_json_object(body: Column) -> Column:
    """Whether a body is one whole JSON object without repeated names; false for NULL, other JSON values and broken text.

    The parser ignores what follows a value, so the body is read as the one element of a list
    and as a field before another field: text behind it breaks at least one of them.
    """
    body = F.coalesce(body, F.lit(""))
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    followed = F.try_parse_json(F.concat(F.lit('{"body":'), body, F.lit(',"end":1}')))
    return F.coalesce(
        F.schema_of_variant(listed).startswith("ARRAY<OBJECT") & F.try_variant_get(listed, "$[1]", "variant").isNull()
        & (F.try_variant_get(followed, "$.end", "int") == 1), F.lit(False))


def read_request(body: Column) -> Column:
    """``message, error`` of a JSON request: the field, empty if it is missing or null, and an error for a malformed body.

    A message that is a number or another value counts as its JSON text.
    """
    message = F.coalesce(F.get_json_object(body, "$.message"), F.lit(""))
    ok = is_json_object(body)
    return F.struct(F.when(ok, message).otherwise("").alias("message"), F.when(~ok, MALFORMED).alias("error"))


def parse_request(body: Column) -> Column:
    """The message of a JSON request alone."""
    return read_request(body)["message"]


def clean_request(df: DataFrame, message: str = "message", error: str = "error") -> DataFrame:
    """Strip the message, and add an error where it is empty and none is there yet, and ``status``."""
    stripped = strip_message(F.coalesce(F.col(message), F.lit("")))
    fault = F.col(error) if error in df.columns else F.lit(None).cast("string")
    return df.withColumn(message, stripped).withColumn(error, F.coalesce(fault, F.when(F.col(message) == "", EMPTY_MESSAGE))).withColumn(
        "status", F.when(F.col(error).isNull(), "success").otherwise("error"))


def score_answer(probability: Column) -> Column:
    """The JSON answer of a scored message, the probability with four decimals."""
    return answer_json(F.lit("success"), verdict(probability), F.round(probability, 4).cast("decimal(5,4)"), F.lit(None).cast("string"))


def error_answer(error: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("status"), error.alias("error")))


def answer_json(status: Column, result: Column, probability: Column, error: Column) -> Column:
    """``to_json`` leaves out null fields, so errors carry only status and error."""
    ok = status == "success"
    return F.to_json(F.struct(
        status.alias("status"),
        F.when(ok, result).alias("result"),
        F.when(ok, probability).alias("probability"),
        F.when(~ok, error).alias("error"),
    ))


def answer_key(message: Column, model: str | None = None) -> Column:
    """Cache key of a message; naming the model keeps models from sharing answers."""
    prefix = KEY_PREFIX if model is None else f"{KEY_PREFIX}{model}:"
    return F.concat(F.lit(prefix), F.sha2(message, 256))


def request_fault(text: Column) -> Column:
    """Error code of a text that must not be sent for enrichment; empty when it may."""
    return F.when(F.coalesce(text, F.lit("")) == "", EMPTY_TEXT).otherwise("")


def parse_translation(body: Column) -> tuple[Column, Column]:
    """Translated text and error code of an enrichment answer."""
    parsed = F.get_json_object(body, "$.translatedText")
    error = (
        F.when(~is_json_object(body), "bad_json").when(parsed.isNull(), "no_translatedText_in_response").otherwise("")
    )
    return F.when(error == "", parsed).otherwise(""), error


def spam_probability(df: DataFrame) -> Column:
    """Probability of class 1, or the logistic of the margin for models without one."""
    if "probability" in df.columns:
        return vector_to_array("probability")[1]
    return 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))


def score_kind(df: DataFrame) -> Column:
    return F.lit("probability" if "probability" in df.columns else "margin")
