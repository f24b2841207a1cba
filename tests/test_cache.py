import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tamis.functions.answers import ANSWER_TTL_SECONDS
from tamis.operators import answer_cache

START = datetime(2024, 1, 1)


def brute_force(requests, ttl=ANSWER_TTL_SECONDS, failed=()):
    hits, expiry = {}, {}
    for number, key, at in sorted(requests, key=lambda r: (r[1] or "", r[2], r[0])):
        hits[number] = key in expiry and at < expiry[key]
        if not hits[number] and number not in failed:
            expiry[key] = at + timedelta(seconds=ttl)
    return hits


def replay(spark, requests, **options):
    df = spark.createDataFrame(requests, "number long, name string, at timestamp_ntz")
    done = answer_cache.replay_cache(df, F.col("name"), F.col("at"), F.col("number"), **options)
    return {r.id: r.hit for r in done.collect()}


def test_lifetime_is_exact_and_not_extended(spark):
    offsets = [0, 1, 80_000, 86_399, 86_400, 86_401, 172_799, 172_800]
    requests = [(i, "k", START + timedelta(seconds=s)) for i, s in enumerate(offsets)]
    assert [replay(spark, requests)[i] for i in range(8)] == [False, True, True, True, False, True, True, False]


def many(hot=0.4):
    rng = random.Random(5)
    return [
        (i, "hot" if rng.random() < hot else f"k{rng.randint(0, 15)}",
         START + timedelta(seconds=rng.randint(0, 86_400 * 9), microseconds=rng.choice([0, 1, 999_999])))
        for i in range(900)
    ] + [(900 + i, "hot", START + timedelta(days=20, seconds=i)) for i in range(3)] + [(950 + i, None, START + timedelta(hours=9 * i)) for i in range(9)]


def test_one_hot_key_and_many_others_as_in_sequence(spark):
    requests = many()
    assert replay(spark, requests) == brute_force(requests)


def test_failed_requests_hit_but_store_nothing(spark):
    requests = many()
    rng = random.Random(6)
    failed = {n for n, *_ in requests if rng.random() < 0.5}
    found = replay(spark, requests, ok=~F.col("number").isin(list(failed)))
    assert found == brute_force(requests, failed=failed)


def test_no_python_and_no_task_for_a_key(spark):
    df = spark.createDataFrame(many(), "number long, name string, at timestamp_ntz")
    done = answer_cache.replay_cache(df, F.col("name"), F.col("at"), F.col("number"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "hashpartitioning(key" not in plan


def test_no_requests(spark):
    assert replay(spark, []) == {}


def test_lookup_and_expiry(spark):
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, key string")
    cache = spark.createDataFrame([("a", "SPAM", START)], "key string, result string, stored_at timestamp_ntz")
    assert sorted(r.id for r in answer_cache.cached_answers(requests, cache, "key").collect()) == [1, 3]
    assert [r.id for r in answer_cache.uncached_requests(requests, cache, "key").collect()] == [2]
    for seconds, alive in ((86_399, 1), (86_400, 0)):
        now = F.lit(START + timedelta(seconds=seconds)).cast("timestamp_ntz")
        assert answer_cache.unexpired(cache, "stored_at", now).count() == alive
