"""The scoring service as a table job: requests in, answers out, stored answers used and extended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions import answers
from tamis.operators.answer_cache import cached_answers, uncached_requests
from tamis.operators.bitmaps import possible_members
from tamis.session import discard, materialize
from tamis.sources.answer_store import AnswerStore


def _once(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is read.

    Filters and projections on it are not moved below the explode of the one value, where each of
    their uses would compute it again.
    """
    return df.withColumn(name, F.explode(F.array(name)))


def _parsed(requests: DataFrame) -> DataFrame:
    """``id, message, error`` of ``requests(id, body)``, the message stripped."""
    read = _once(requests.select("id", answers.read_request(F.col("body")).alias("request")), "request")
    clean = answers.clean_request(read.select("id", "request.*"))
    return _once(clean.select("id", F.struct("message", "error").alias("request")), "request").select("id", "request.*")


def answer_requests(requests: DataFrame, store: AnswerStore, score: Callable[[DataFrame], DataFrame], now: Column,
                    model: str | None = None) -> DataFrame:
    """``id, answer, cached`` for every row of ``requests(id, body)``; ids must be unique.

    Every request is parsed and its message hashed once, those that may be scored are parsed once
    more. A message with a live stored answer
    gets it. Of equal messages without one the request of smallest id is scored, the others get
    its answer, as they would in sequence; new answers are stored with the time ``now``.
    ``score`` turns ``id, message`` into ``id, probability``. Malformed, empty and NULL requests
    get an error, which is never stored. A call without new messages scores nothing.

    ``cached`` is 1 where no score was computed for the request itself and it has no error.
    """
    keyed = materialize(_parsed(requests).select("id", "error", answers.answer_key(F.col("message"), model).alias("key")), "requests")
    valid = keyed.where("error IS NULL").select("id", "key")
    known = materialize(store.live(now), "live-answers")
    fresh = uncached_requests(valid, known, "key")
    first = materialize(fresh.groupBy("key").agg(F.min("id").alias("id")), "first-requests")
    told = cached_answers(valid, known, "key").select("id", "answer", F.lit(1).alias("cached"))
    if not first.isEmpty():
        texts = _parsed(possible_members(requests.select("id", "body"), "id", first.select("id"))).where("error IS NULL").select("id", "message")
        scored = score(texts).select("id", answers.score_answer(F.col("probability")).alias("answer"))
        new = materialize(scored.join(first, "id").select("key", "answer", F.col("id").alias("first_id"), now.cast("timestamp").alias("stored_at")), "new-answers")
        store.add(new)
        told = told.unionByName(cached_answers(valid, new, "key").select(
            "id", "answer", (F.col("id") != F.col("first_id")).cast("int").alias("cached")))
    errors = keyed.where("error IS NOT NULL").select("id", answers.error_answer(F.col("error")).alias("answer"), F.lit(0).alias("cached"))
    return told.unionByName(errors)
