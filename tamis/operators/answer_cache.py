"""Stored answers: lookup by key, and the 24-hour lifetime replayed over a log of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tamis.functions.answers import ANSWER_TTL_SECONDS
from tamis.operators.joins import salted_join
from tamis.operators.ranking import global_rank
from tamis.session import materialize


def cached_answers(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests whose key is stored, with the stored columns. Cache keys must be unique."""
    return salted_join(requests, cache, key, "inner")


def uncached_requests(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return salted_join(requests, cache.select(key), key, "left_anti")


def unexpired(cache: DataFrame, stored_at: str, now: Column, ttl: int = ANSWER_TTL_SECONDS) -> DataFrame:
    return cache.where(F.col(stored_at) + F.make_dt_interval(secs=F.lit(ttl)) > now)


def _successors(nodes: DataFrame, length: int) -> DataFrame:
    """``n, next``: for each numbered request the first one of its key at or after its expiry, if there is one.

    Requests and their expiries are numbered in one order. An expiry's place in it, less the
    expiries before it, is the number of requests before it, which is the number of the request
    that follows. Expiries are in the order of their requests, so that is a subtraction.
    """
    requests = nodes.select("key", "micros", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("n"), "id")
    expiries = nodes.select("key", (F.col("micros") + length).alias("micros"), F.lit(0).alias("kind"), "n", F.lit(None).cast(nodes.schema["id"].dataType).alias("id"))
    placed = global_rank(requests.unionByName(expiries), [F.asc(c) for c in ("key", "micros", "kind", "n", "id")], "place").where("kind = 0")
    following = placed.select("n", "key", (F.col("place") - F.col("n")).alias("next"))
    same = nodes.select(F.col("n").alias("next"), F.col("key").alias("next_key"))
    return following.join(same, "next").where(F.col("key").eqNullSafe(F.col("next_key"))).select("n", "next")


def _stores(nodes: DataFrame, length: int) -> DataFrame:
    """``n`` of the requests that store: the first of each key, its successor, that one's successor and so on.

    With links of 1, 2, 4 ... successors the requests reached double in each round; two joins on
    unique numbers a round, and as many rounds as the longest chain has binary digits.
    """
    links = materialize(_successors(nodes, length), "links")
    stores = materialize(nodes.groupBy("key").agg(F.min("n").alias("n")).select("n"), "stores")
    while True:
        reached = materialize(links.join(stores, "n", "left_semi").select(F.col("next").alias("n")), "reached")
        if reached.isEmpty():
            return stores
        stores = materialize(stores.unionByName(reached), "stores")
        further = links.select(F.col("n").alias("next"), F.col("next").alias("after"))
        links = materialize(links.join(further, "next").select("n", F.col("after").alias("next")), "links")


def _covered(nodes: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """``rows`` with ``hit``: whether the last store of the key before a row, by the order of requests, is still alive."""
    stored = materialize(global_rank(nodes.select("key", "micros", "id"), [F.asc(c) for c in ("key", "micros", "id")], "n"), "stored")
    asked = global_rank(rows, [F.asc(c) for c in ("key", "micros", "id")], "n")
    asked = materialize(asked, "asked")
    both = stored.select("key", "micros", "id", F.lit(None).cast("long").alias("n")).unionByName(asked.select("key", "micros", "id", "n"))
    placed = global_rank(both, [F.asc(c) for c in ("key", "micros", "id", "n")], "place").where("n IS NOT NULL")
    last = stored.select(F.col("n").alias("last"), F.col("key").alias("last_key"), F.col("micros").alias("since"))
    alive = F.col("key").eqNullSafe(F.col("last_key")) & (F.col("micros") < F.col("since") + length)
    return placed.withColumn("last", F.col("place") - F.col("n") - 1).join(last, "last", "left").select(
        "id", "key", "micros", F.coalesce(alive, F.lit(False)).alias("hit"))


def replay_cache(requests: DataFrame, key: Column, at: Column, request_id: Column,
                 ttl: int = ANSWER_TTL_SECONDS, ok: Column | None = None) -> DataFrame:
    """``(id, key, micros, hit)`` for a request log, ordered per key by time, then id; ids must be unique.

    The first request of a key stores an answer; requests before its expiry hit and do not
    extend it; the first one at or after the expiry stores again. A request that is not ``ok``
    hits like any other, but stores nothing. NULL is a key of its own. Requests are numbered in
    parallel and joined on their numbers, so no key's requests meet in one task.
    """
    length = ttl * 1_000_000
    rows = requests.select(
        request_id.alias("id"), key.alias("key"), F.unix_micros(at.cast("timestamp")).alias("micros"),
        (F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))).alias("ok")
    )
    order = [F.asc(c) for c in ("key", "micros", "id")]
    nodes = materialize(global_rank(rows.where("ok").drop("ok"), order, "n"), "requests")
    marked = nodes.join(_stores(nodes, length).withColumn("stored", F.lit(True)), "n", "left")
    answered = marked.select("id", "key", "micros", F.col("stored").isNull().alias("hit"))
    if ok is None:
        return answered
    stored = marked.where("stored").select("key", "micros", "id")
    return answered.unionByName(_covered(stored, rows.where("NOT ok").drop("ok"), length))
