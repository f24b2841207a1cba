import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tamis.operators import bitmaps, joins


def test_bits_of_a_bitmap(spark):
    held = [0, 1, 7, 8, 32_767, 32_768, 100_000, 100_000]
    blocks = bitmaps.bitmap(spark.createDataFrame([(c,) for c in held], "cell long"), "cell")
    asked = spark.createDataFrame([(c,) for c in [*held, 2, 9, 32_769, 99_999, 500_000]], "asked long")
    marked = asked.join(blocks, F.floor(F.col("asked") / bitmaps.BLOCK_BITS) == F.col("block"), "left").select(
        "asked", bitmaps.bit_set(F.col("bits"), F.col("asked")).alias("set"))
    assert {r.asked: r.set for r in marked.collect()} == {c: c in held for c in [*held, 2, 9, 32_769, 99_999, 500_000]}


@pytest.mark.parametrize("broadcast", [True, False])
def test_derived_join_equals_a_plain_join(spark, monkeypatch, broadcast):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1000 if broadcast else 0)
    draw = random.Random(1)
    wide = spark.createDataFrame([(draw.choice([None, *range(300)]), f"text {i}") for i in range(500)], "id long, text string")
    table = spark.createDataFrame([(k, k % 3) for k in range(0, 400, 7)], "id long, label int")
    for how in ("inner", "left", "left_anti"):
        found = joins.derived_join(wide, table, "id", lambda rows: rows.select("id", F.md5("text").alias("digest")), how)
        expected = wide.select("id", F.md5("text").alias("digest")).join(table, "id", how)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.select(found.columns).collect()))


def test_possible_members_lose_none_and_let_few_others_through(spark):
    rows = spark.range(20_000).withColumn("text", F.lit("x"))
    keys = spark.range(0, 20_000, 10)
    found = {r.id for r in bitmaps.possible_members(rows, "id", keys).collect()}
    assert set(range(0, 20_000, 10)) <= found and len(found) < 4500
    assert bitmaps.possible_members(rows, "id", keys.limit(0)).count() == 0


def shuffled_columns(df):
    """Names of all columns that cross an exchange of the plan, and the kinds of its nodes."""
    crossing, kinds, todo = set(), set(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kinds.add(node.nodeName())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
        if node.nodeName() in ("Exchange", "BroadcastExchange"):
            crossing |= {c.partition("#")[0] for c in node.output().mkString(",").split(",")}
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return crossing, kinds


@pytest.mark.parametrize("name", ["nb_score", "score_batch", "concat_mixed"])
def test_no_text_crosses_an_exchange_though_labels_are_too_many_to_broadcast(spark, small, monkeypatch, tmp_path, name):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    for table in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{small}/{table}.parquet").repartition(8).write.parquet(f"{tmp_path}/{table}.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # a split for each file
    try:
        found = queries()[name](spark, str(tmp_path))
        crossing, joins_used = shuffled_columns(found)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert crossing and not {"text", "words", "filtered", "message"} & crossing
    assert "SortMergeJoin" in joins_used
    assert sorted(map(repr, found.collect())) == sorted(map(repr, queries()[name](spark, small).collect()))


def test_an_unknown_word_in_half_the_rows_is_dealt_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_FREQUENT", 500)
    monkeypatch.setattr(joins, "HOT_KEYS", 50)
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "unknown").when(F.col("id") % 1000 == 1, F.lit(None)).when(
        F.col("id") % 10 == 3, "known").otherwise(F.concat(F.lit("w"), F.col("id") % 4001)).alias("word"))
    table = spark.createDataFrame([(f"w{k}", k, 1) for k in range(0, 4001, 2)] + [("known", -1, 1)], "word string, value int, weight int")
    settings = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = joins.lookup(rows, table, "word", False, weight="weight")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("part")).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 20
        expected = rows.join(table, "word", "left").select(found.columns)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
