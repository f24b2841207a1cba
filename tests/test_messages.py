import pytest
from pyspark.sql import functions as F

from tamis.operators import messages
from tamis.sources.answer_store import AnswerStore
from tamis.sources.manifests import Manifests

REQUESTS = [(1, '{"message":" buy now "}'), (2, '{"message":"buy now"}'), (3, '{"message":" "}'), (4, "{}"), (5, "broken"), (6, None), (7, '{"message":"hello"}'),
            (8, '{"message":null}')]


def at(hours):
    return F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))


def score(rows):
    return rows.withColumn("probability", F.when(F.col("message").contains("buy"), 0.9).otherwise(0.1))


def never(rows):
    raise AssertionError("nothing is to be scored")


def ask(spark, store, hours, score, requests=REQUESTS, **more):
    df = spark.createDataFrame(requests, "id long, body string")
    return {r.id: (r.answer, r.cached) for r in messages.answer_requests(df, store, score, at(hours), **more).collect()}


SPAM = '{"status":"success","result":"SPAM","probability":0.9000}'
HAM = '{"status":"success","result":"NOT SPAM","probability":0.1000}'
EMPTY, BROKEN = '{"status":"error","error":"Empty message"}', '{"status":"error","error":"Malformed request"}'


def test_answers_are_stored_for_a_day_and_errors_never(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path))
    errors = {3: (EMPTY, 0), 4: (EMPTY, 0), 5: (BROKEN, 0), 6: (BROKEN, 0), 8: (EMPTY, 0)}
    assert ask(spark, store, 0, score) == {1: (SPAM, 0), 2: (SPAM, 1), 7: (HAM, 0)} | errors
    assert sorted(r.answer for r in store.live(at(0)).collect()) == sorted([SPAM, HAM])
    assert ask(spark, store, 23, never) == {1: (SPAM, 1), 2: (SPAM, 1), 7: (HAM, 1)} | errors  # a hit does not extend the lifetime
    assert ask(spark, store, 24, score) == {1: (SPAM, 0), 2: (SPAM, 1), 7: (HAM, 0)} | errors
    assert ask(spark, store, 47, never, [(9, '{"message":"hello"}')]) == {9: (HAM, 1)}
    assert ask(spark, store, 24, never, []) == {}


def test_models_do_not_share_answers(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path))
    ask(spark, store, 0, score, model="a")
    with pytest.raises(AssertionError):
        ask(spark, store, 1, never, model="b")
    assert ask(spark, store, 1, never, model="a")[1] == (SPAM, 1)


def test_compaction_keeps_live_answers_and_what_others_add_meanwhile(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path))

    def rows(*keys, hours=0):
        return spark.createDataFrame([(k, k.upper()) for k in keys], "key string, answer string").withColumn("stored_at", at(hours))

    store.add(rows("a"))
    store.add(rows("b", hours=10))
    store.add(rows("b", "c", hours=11))  # two writers stored b
    live = store.live

    def live_and_a_delta_of_another_writer(now):
        found = live(now)
        store.live = live
        AnswerStore(spark, str(tmp_path)).add(rows("d", hours=12))
        return found

    store.live = live_and_a_delta_of_another_writer
    store.compact(at(25), keep=False)
    assert sorted(r.key for r in store.live(at(25)).collect()) == ["b", "c", "d"]
    parts = store.manifests.newest()[1]
    assert [p.partition("-")[0] for p in parts] == ["snapshot", "delta"]
    assert sorted(p.name for p in tmp_path.iterdir() if "-" in p.name) == sorted(parts)


def test_of_two_writers_one_publishes_a_version(spark, tmp_path):
    log = Manifests(spark, str(tmp_path))
    assert log.newest() == (0, [])
    assert log.publish(1, ["x"]) and not log.publish(1, ["y"])
    assert log.newest() == (1, ["x"])
    seen = []

    def edit(lines):
        seen.append(list(lines))
        if len(seen) == 1:
            Manifests(spark, str(tmp_path)).change(lambda other: [*other, "faster"])
        return [*lines, "slower"]

    assert log.change(edit) == 3 and log.newest()[1] == ["x", "faster", "slower"] and len(seen) == 2


def test_a_request_that_is_scored_is_parsed_in_one_place(spark, tmp_path):
    plans = []

    def watched(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return score(rows)

    assert ask(spark, AnswerStore(spark, str(tmp_path)), 0, watched)[1] == (SPAM, 0)
    parsing = [line for line in plans[0].splitlines() if "json" in line.lower()]
    assert len(parsing) == 1 and "Filter" not in parsing[0]
